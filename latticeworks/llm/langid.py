"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into BUCKETS buckets; a text's feature is its relative frequency there times the
bucket's inverse document frequency. Document frequencies count all training documents. Weights are fitted by
follow-the-regularised-leader with L1 and L2 penalties on a bounded sample (PER_LANG documents of each language), and a part of
that sample sets the temperature that calibrates scores. A language is accepted if its score is good enough, or if the text has so
few letters that a low score says nothing (see accepted).

Defined results: a null text and one without letters give lang_pred `und` and score 0; without any labelled training document all
texts do. Ties go to the language that sorts first. Letters are case-folded, everything else counts as a blank.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .text import give_back, slices

#: Buckets of n-grams, longest n-gram, sampled training documents of a language at most, their longest in UTF-8 bytes, share of them that sets the temperature.
BUCKETS, ORDER, PER_LANG, SAMPLE_BYTES, CALIBRATION = 1 << 16, 3, 700, 200_000, 5
#: Scale of a feature; learning rate, its offset, L1 and L2 of the regression; passes over the sample.
SCALE, ALPHA, BETA, L1, L2, EPOCHS = 20.0, 0.5, 1.0, 0.02, 0.01, 4
UNKNOWN = "und"
#: How far the score of a long accepted text is from chance (0) towards certainty (1) at least, and the letters of a text of which half of that is asked.
LEAST_MARGIN, HALF_LETTERS = 1 / 3, 75


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Of each code point its lower-case letter, or a blank."""
    low = (chr(i).lower() if chr(i).isalpha() else " " for i in range(0x110000))
    return np.fromiter((ord(c) if len(c) == 1 else ord(c[0]) for c in low), np.uint32, 0x110000)


_K = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def ngrams(column: pa.Array, order: int = ORDER, buckets: int = BUCKETS):
    """For each row: (bucket of every n-gram, number of letters)."""
    fold, shift = folding(), np.uint32(32 - (buckets.bit_length() - 1))
    for _, buf, bounds in slices(column):
        chars = fold[np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        rows = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[bounds] if len(buf) else np.zeros(len(bounds), np.int64)
        letter = chars != 32
        letters = np.concatenate([[0], np.cumsum(letter)])[rows]
        hashed, h = [], np.zeros(len(chars), np.uint32)
        for n in range(1, order + 1):
            h = h[: len(chars) - n + 1] * _K[0] + chars[n - 1 :] * _K[1] + _K[2] if len(chars) >= n else h[:0]
            hashed.append(((h ^ (h >> np.uint32(15))) * _K[2]) >> shift)
        for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
            yield np.concatenate([x[a : max(a, b - n)] for n, x in enumerate(hashed)]), int(letters[i + 1] - letters[i])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, column: pa.Array) -> tuple[list[str], list[float], list[int]]:
        """(language, calibrated probability, letters) of each text."""
        names, scores, counts = [], [], []
        for idx, letters in ngrams(column):
            counts.append(letters)
            if not letters or not self.langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = (self.weights[idx].sum(0, dtype=np.float64) / len(idx) + self.bias) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            names.append(self.langs[int(p.argmax())])
            scores.append(float(p.max()))
        return names, scores, counts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for a softmax over classes; a row of state per feature."""

    def __init__(self, features: int, classes: int) -> None:
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        g = softmax(x @ w)
        g[label] -= 1
        g = x[:, None] * g
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g


def fit_sample(sample: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, seed: int = 1) -> Model:
    """From (buckets, counts, language) of sampled documents, in an order that does not matter."""
    langs = sorted({s[2] for s in sample})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rows = sorted(sample, key=lambda s: (s[2], len(s[0]), blake2b(s[0].tobytes() + s[1].tobytes(), digest_size=16).digest()))
    data = [(np.append(i, np.int32(BUCKETS)), np.append(c / c.sum() * idf[i] * SCALE, 1.0).astype(np.float32), langs.index(lang)) for i, c, lang in rows]
    order = np.random.default_rng(seed).permutation(len(data))
    # of each language every so-manieth example is left out for the temperature, whatever their number
    seen, train, held = [0] * len(langs), [], []
    for k in order:
        seen[data[k][2]] += 1
        (train if seen[data[k][2]] % CALIBRATION else held).append(data[k])
    ftrl = Ftrl(BUCKETS + 1, len(langs))
    for _ in range(EPOCHS):
        for example in train:
            ftrl.step(*example)
    w = ftrl.weights()
    if not held:  # nothing left out, nothing to calibrate by
        return Model(langs, (w[:BUCKETS] * idf[:, None] * SCALE).astype(np.float32), w[BUCKETS], 1.0)
    logits, labels = np.array([x @ w[i] for i, x, _ in held]), np.array([y for *_, y in held])
    # targets are smoothed by one document of each language, so that a few separable ones do not make every score certain
    target = (np.eye(len(langs))[labels] * len(labels) + 1) / (len(labels) + len(langs))
    losses = {t: -(target * np.log(np.maximum(softmax(logits / t), 1e-12))).sum(1).mean() for t in np.geomspace(0.1, 10, 41)}
    return Model(langs, (w[:BUCKETS] * idf[:, None] * SCALE).astype(np.float32), w[BUCKETS], float(min(losses, key=losses.get)))


def fit(train: DataFrame, per_lang: int = PER_LANG) -> Model:
    """From all rows of train (doc_id, text, lang); rows without text or language are left out."""
    rows = train.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kinds = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("df", pa.int64())])

    def frequencies(batches):
        df, docs = np.zeros(BUCKETS, np.int64), {}
        for b in batches:
            for lang in b.column(1).to_pylist():
                docs[lang] = docs.get(lang, 0) + 1
            for idx, _ in ngrams(b.column(0)):
                seen = np.zeros(BUCKETS, bool)
                seen[idx] = True
                df += seen
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.string()), pa.array(found, pa.int32()), pa.array(df[found])], schema=kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array([-1] * len(docs), pa.int32()), pa.array(list(docs.values()), pa.int64())], schema=kinds)

    counted = rows.select("text", "lang").mapInArrow(frequencies, "lang string, bucket int, df long").groupBy("lang", "bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, n = counted.column("bucket").to_numpy(), counted.column("df").to_numpy()
    docs = dict(zip(counted.column("lang").filter(pa.array(bucket < 0)).to_pylist(), n[bucket < 0].tolist(), strict=True))
    df = np.zeros(BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = np.log((1 + sum(docs.values())) / (1 + df)) + 1
    if not docs:
        return fit_sample([], idf)

    def features(batches):
        for b in batches:
            made = [np.unique(idx, return_counts=True) for idx, _ in ngrams(b.column(0))]
            at = pa.array(np.cumsum([0, *(len(i) for i, _ in made)]), pa.int32())
            flat = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([m[k] for m in made]) if made else [], pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(1), *flat], ["lang", "i", "c"])

    share = F.lit(None).cast("double")
    for lang, m in docs.items():
        share = F.when(F.col("lang") == lang, F.lit(1.3 * per_lang / m)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)).where(F.octet_length("text") <= SAMPLE_BYTES).select("text", "lang")
    sample = chosen.mapInArrow(features, "lang string, i array<int>, c array<int>").where("size(i) > 0").limit(2 * per_lang * len(docs)).toArrow()
    model = fit_sample([x for b in sample.to_batches() for x in _unpacked(b)], idf)
    del sample
    give_back()
    return model


def _unpacked(batch: pa.RecordBatch):
    """(buckets, counts, language) of each row, as views of the batch."""
    i, c = batch.column(1), batch.column(2)
    at, i, c = i.offsets.to_numpy(), i.values.to_numpy(), c.values.to_numpy()
    for k, lang in enumerate(batch.column(0).to_pylist()):
        yield i[at[k] : at[k + 1]], c[at[k] : at[k + 1]], lang


def is_held_out(fold: int, folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score", letters: str = "letters") -> DataFrame:
    """docs with the language, its score and the number of letters of each text; every other column stays."""
    made = (lang, score, letters)
    kept = [c for c in docs.columns if c not in made]
    at = kept.index("text")

    def run(batches):
        for b in batches:
            names, scores, counts = model.predict(b.column(at).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], [*b.schema.names, *made])

    own = docs.select(*kept)
    return own.mapInArrow(run, StructType([*own.schema.fields, *(StructField(c, t()) for c, t in zip(made, (StringType, DoubleType, LongType), strict=True))]))


def accepted(model: Model, lang: str = "lang_pred", score: str = "score", letters: str = "letters", langs: list[str] | None = None, margin: float = LEAST_MARGIN, half: int = HALF_LETTERS) -> Column:
    """Whether a text is of one of the languages langs (default: any learned one): not `und`, and with a score that is far enough from
    chance. A long text must go `margin` of the way from chance to certainty (0.5 for four languages), one of n letters n / (n + half) of
    that, as fewer letters give less evidence; so a text of any length is judged by its score."""
    named = F.col(lang).isin(*langs) if langs is not None else F.col(lang) != UNKNOWN
    chance = 1 / max(1, len(model.langs))
    return named & (F.col(score) >= chance + (1 - chance) * margin * F.col(letters) / (F.col(letters) + half))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~is_held_out(0, 5)))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(0, 5).alias("held_out"), F.col("text").cast("string").alias("text")), model).select("doc_id", "held_out", "lang_pred", "score", "letters")
