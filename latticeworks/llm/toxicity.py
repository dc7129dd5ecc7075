"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of rows of hashed tables: the word itself and its first four, five and six bytes, so that unseen
forms of a known stem are seen too. Filters of three widths run over all words of a text, each keeps its POOLS largest values (one hit
in a long text means little, several do not occur by chance), and a logistic layer scores them. One column of the tables starts from shrunken log-odds of the training labels. Weights are trained on a
bounded sample of labelled documents (CLASS_ROWS of each label; of a document of more than WORDS words, so many in spans of SPAN spread
over its whole length). Thresholds and the slope of scores come from all labelled documents that gave no weights, whole: tasks score
them and count labels by language and score bin. A language guessed from the words (naive Bayes over the same buckets) picks the
threshold, and scores are shifted so that every language's threshold is 0.3.

Defined results: a null or empty text is scored like one without any match; a document labelled twice is toxic if any label says
so; null labels are ignored; with labels of one kind only, or none, every score is 0. Other columns are no input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .sieve import passes, sieve
from .text import LOWER, give_back, hash_spans, slices, word_spans

#: Rows of the hashed tables, prefix lengths, size of an embedding, filter widths, filters of a width, values that a filter keeps.
TABLES, PREFIXES, SIZE, WIDTHS, FILTERS, POOLS = (1 << 15, 1 << 14, 1 << 14, 1 << 14), (4, 5, 6), 8, (1, 2, 3), 10, 3
#: Sampled training documents of a label, words that are taken of one at most and of a span, one in so many documents gives no weights, passes, documents of a step, step size, error below which a document teaches nothing.
CLASS_ROWS, WORDS, SPAN, CALIBRATION, EPOCHS, BATCH, RATE, ENOUGH = 2000, 4000, 40, 4, 6, 16, 0.02, 1e-3
#: Bins of a logit for thresholds; languages with fewer documents of a label take the overall threshold.
BIN, MOST_LOGIT, LEAST_OF_LABEL = 0.01, 40.0, 10
THRESHOLD = 0.3
TRIM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_rows(column: pa.Array):
    """For slices of a column: (rows of the tables for every word, row boundaries in them)."""
    for _, buf, bounds in slices(column):
        low = LOWER[buf]
        starts, ends, rows = word_spans(low, bounds)
        for _ in range(8):  # quotes, brackets and stops around a word
            at = np.flatnonzero((ends - starts > 1) & TRIM[low[np.minimum(starts, len(low) - 1)]]) if len(low) else starts
            starts[at] += 1
            at = np.flatnonzero((ends - starts > 1) & TRIM[low[ends - 1]]) if len(low) else starts
            ends[at] -= 1
        parts = [hash_spans(low, starts, ends, 1)] + [hash_spans(low, starts, np.minimum(ends, starts + p), p) for p in PREFIXES]
        yield np.stack([(h % np.uint64(n)).astype(np.int32) for h, n in zip(parts, TABLES, strict=True)], 1), rows


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    langs: np.ndarray = field(default_factory=lambda: np.zeros((TABLES[0], 0), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    trained: bool = True
    borrowed: list[int] = field(default_factory=list)  # languages with the threshold of all

    def embed(self, words: np.ndarray) -> np.ndarray:
        return sum(t[words[:, k]] for k, t in enumerate(self.tables))

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each width the values of every filter (rows) at every place of a row of words."""
        made, x = [], np.ascontiguousarray(x.T)
        for w, c in zip(self.filters, self.offsets, strict=True):
            n = x.shape[1] - len(w) + 1
            made.append(sum(w[j].T @ x[:, j : j + n] for j in range(len(w))) + c[:, None] if n > 0 else np.zeros((FILTERS, 0), np.float32))
        return made

    def logits(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language) of each text of a slice."""
        maps = self.maps(self.embed(words))
        guess = self.langs[words[:, 0]] if self.langs.shape[1] else None
        z, lang = np.full(len(rows) - 1, self.bias), np.zeros(len(rows) - 1, np.int64)
        for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
            pools = [largest(m[:, a : max(a, b - len(w) + 1)]) for m, w in zip(maps, self.filters, strict=True)]
            z[i] += np.concatenate(pools).ravel() @ self.out
            if guess is not None and b > a:
                lang[i] = guess[a:b].sum(0).argmax()
        return z, lang

    def calibrated(self, z: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.thresholds[lang]) + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(column))
        return np.concatenate([self.calibrated(*self.logits(w, r)) for w, r in word_rows(column)] or [np.zeros(0)])


def largest(m: np.ndarray, k: int = POOLS) -> np.ndarray:
    """(k, rows): the largest values of each row, largest first, no less than 0; zeros where there are fewer."""
    n = m.shape[1]
    top, out = np.partition(m, n - k, axis=1)[:, n - k :] if n > k else m, np.zeros((k, len(m)), m.dtype)
    out[: min(n, k)] = np.sort(top, axis=1)[:, ::-1].T
    return np.maximum(out, 0)


def places_of(m: np.ndarray, k: int = POOLS) -> np.ndarray:
    """(k or fewer, rows): the places of those values."""
    n = m.shape[1]
    order = np.argpartition(m, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(m), 1))
    rows = np.arange(len(m))[:, None]
    return order[rows, np.argsort(-m[rows, order], axis=1, kind="stable")].T


def log_odds(docs: list[np.ndarray], labels: np.ndarray, table: int) -> np.ndarray:
    """By row of a table: how much likelier a toxic document has it, shrunk where few documents do."""
    count = np.zeros((2, TABLES[table]))
    for words, y in zip(docs, labels, strict=True):
        count[int(y), np.unique(words[:, table])] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    raw = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    seen = count.sum(0)
    return np.where(seen > 0, raw * seen / (seen + 5), 0.0)


def best_threshold(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the gap between scores z that gives the best F1; toxic and clean are counts at each score."""
    order = np.argsort(z)
    z, toxic, clean = z[order], toxic[order], clean[order]
    tp = toxic[::-1].cumsum()[::-1]  # predicted from i on
    f1 = 2 * tp / (tp + clean[::-1].cumsum()[::-1] + toxic.sum())
    i = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
    return float((z[i] + z[i - 1]) / 2) if i else float(z[0] - 1)


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 3) -> Model:
    """docs: table rows of each document's words; langs only set up the language guess."""
    rng = np.random.default_rng(seed)
    f = np.float32
    model = Model([rng.normal(0, 0.05, (n, SIZE)).astype(f) for n in TABLES], [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(f) for w in WIDTHS], [np.zeros(FILTERS, f) for _ in WIDTHS], np.full(POOLS * FILTERS * len(WIDTHS), 0.3 / POOLS))
    own = np.arange(len(docs))
    for k in range(len(TABLES)):
        model.tables[k][:, 0] = log_odds([docs[i] for i in own], labels[own], k) / 3
    for w in model.filters:
        w[0, :, 0] = np.eye(SIZE)[0]
    names = sorted({x for x in langs if x is not None})
    if names:
        count = np.ones((TABLES[0], len(names)))
        for i in own:
            if langs[i] is not None:
                np.add.at(count[:, names.index(langs[i])], docs[i][:, 0], 1)
        model.langs = np.log(count / count.sum(0)).astype(f)
    dense = [*model.filters, *model.offsets, model.out]
    first, second, sums, t = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], [np.full((n, 1), 1e-3, f) for n in TABLES], 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(own)
        for at in range(0, len(shuffled), BATCH):
            grads, bias, rows, values = [np.zeros_like(p) for p in dense], 0.0, [], []
            for i in shuffled[at : at + BATCH]:
                words = docs[i]
                if not len(words):
                    continue
                x = model.embed(words)
                maps = model.maps(x)
                places, pools = [places_of(m) for m in maps], np.zeros((POOLS * len(WIDTHS), FILTERS), f)
                for k, (m, p) in enumerate(zip(maps, places, strict=True)):
                    pools[k * POOLS : k * POOLS + len(p)] = np.maximum(m[np.arange(FILTERS), p], 0)
                d = weight[i] * (1 / (1 + np.exp(-np.clip(pools.ravel() @ model.out + model.bias, -30, 30))) - labels[i]) / BATCH
                if abs(d) * BATCH < ENOUGH:
                    continue
                grads[-1] += d * pools.ravel()
                bias += d
                back = (d * model.out.reshape(pools.shape) * (pools > 0)).astype(f)
                for k, (w, found) in enumerate(zip(model.filters, places, strict=True)):
                    g = back[k * POOLS : k * POOLS + len(found), :, None]
                    grads[len(WIDTHS) + k] += g.sum((0, 2))
                    for j in range(len(w)):
                        grads[k][j] += (x[found + j] * g).sum(0).T
                        rows.append(words[(found + j).ravel()])
                        values.append((w[j].T * g).reshape(-1, SIZE))
            t += 1
            for p, g, a, b in zip(dense, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
            model.bias -= RATE * bias * BATCH / 4
            if rows:
                r, v = np.concatenate(rows), np.concatenate(values)
                for k, table in enumerate(model.tables):
                    u, inverse = np.unique(r[:, k], return_inverse=True)
                    g = np.zeros((len(u), SIZE), f)
                    np.add.at(g, inverse, v)
                    sums[k][u] += (g * g).mean(1, keepdims=True)
                    table[u] -= RATE * g / np.sqrt(sums[k][u])
    return model


def calibrate(model: Model, lang: np.ndarray, z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
    """Sets a model's thresholds and slope from counts of both labels by language and score. A language with fewer than LEAST_OF_LABEL
    documents of a label has the threshold of all languages, and is named in model.borrowed."""
    names = max(1, model.langs.shape[1])
    overall = best_threshold(z, toxic, clean) if toxic.sum() and clean.sum() else 0.0
    model.thresholds, model.borrowed = np.full(names, overall), []
    for k in range(names):
        on = lang == k
        if min(toxic[on].sum(), clean[on].sum()) >= LEAST_OF_LABEL:
            model.thresholds[k] = best_threshold(z[on], toxic[on], clean[on])
        else:
            model.borrowed.append(k)
    d = np.clip(np.geomspace(0.1, 10, 41)[:, None] * (z - model.thresholds[lang]), -40, 40)
    losses = (np.log1p(np.exp(-d)) * toxic + np.log1p(np.exp(d)) * clean).sum(1)
    model.slope = float(np.geomspace(0.1, 10, 41)[losses.argmin()])


def spread(words: np.ndarray, most: int = WORDS, span: int = SPAN) -> np.ndarray:
    """The words of a text, or of a longer one so many in spans at even distances."""
    if len(words) <= most:
        return words
    starts = np.linspace(0, len(words) - span, most // span).astype(np.int64)
    return words[(starts[:, None] + np.arange(span)).ravel()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = CLASS_ROWS) -> Model:
    """docs (doc_id, text, lang) and labels (doc_id, toxic), both of training rows only."""
    untrained = Model([], [], [], np.zeros(0), trained=False)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return untrained
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(CALIBRATION)) > 0
    share = F.when(F.col("toxic") == 1, F.lit(1.6 * rows / counts[1])).otherwise(F.lit(1.6 * rows / counts[0]))
    marked = marked.withColumn("weighs", apart & (draw < share * (1 << 30)))
    chosen = marked.where("weighs").select("doc_id", "toxic").limit(4 * rows)  # bounded, so it can be broadcast

    def features(batches):
        for b in batches:
            made, at = [], [0]
            for words, bounds in word_rows(b.column(2)):
                for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                    made.append(spread(words[i:j]))
                    at.append(at[-1] + made[-1].size)
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(made).ravel() if made else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["toxic", "lang", "words"])

    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = own.join(F.broadcast(chosen), "doc_id").select("toxic", "lang", "text").mapInArrow(features, "toxic int, lang string, words array<int>").where("size(words) > 0").limit(4 * rows).toArrow()
    found = []
    for b in sample.to_batches():
        at, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
        found += [(flat[i:j].reshape(-1, len(TABLES)), y, lang) for i, j, y, lang in zip(at[:-1], at[1:], b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    found.sort(key=lambda x: (len(x[0]), x[0].tobytes(), x[1]))
    y = np.array([x[1] for x in found], float)
    if not 0 < y.sum() < len(y):
        return untrained
    model = train([x[0] for x in found], y, [x[2] for x in found])
    del found, sample
    give_back()
    _thresholds(model, own.where("doc_id IS NOT NULL"), marked.where(~F.col("weighs")).select("doc_id", "toxic"))
    return model


def _thresholds(model: Model, docs: DataFrame, marks: DataFrame) -> None:
    """Calibrates a model on all documents (doc_id, text) with a mark (doc_id, toxic); scores are joined with marks, not texts, and the
    driver sees counts by language and score bin."""
    wanted = sieve(marks, "doc_id")

    def run(batches):
        for b in batches:
            if wanted is not None:
                b = b.filter(pa.array(passes(wanted.value, b.column(0).to_numpy())))
            made = [model.logits(w, r) for w, r in word_rows(b.column(1))]
            z, lang = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0), np.zeros(0, np.int64))
            bins = np.round(np.clip(z, -MOST_LOGIT, MOST_LOGIT) / BIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.astype(np.int32)), pa.array(bins)], ["doc_id", "lang", "bin"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang int, bin int")
    bins = scored.join(marks, "doc_id").groupBy("lang", "bin").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).toArrow()
    lang, at, toxic, n = (bins.column(k).to_numpy() for k in ("lang", "bin", "t", "n"))
    if wanted is not None:
        wanted.destroy()
    calibrate(model, lang, at * BIN, toxic, n - toxic)


def predict(docs: DataFrame, model: Model, score: str = "toxic_score") -> DataFrame:
    """docs with the score; every other column stays."""
    kept = [c for c in docs.columns if c != score]
    at = kept.index("text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(at)), pa.float64())], [*b.schema.names, score])

    own = docs.select(*kept)
    return own.mapInArrow(run, StructType([*own.schema.fields, StructField(score, DoubleType())]))


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs.where(~is_held_out()), labels.where(~is_held_out()))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(own, model).select("doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
