"""Trained models and decisions against plain loops, damaged inputs, and the stages of the pipeline."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import decontaminate, langid, neardup, ngramlm, ogg, toxicity, warc
from latticeworks.llm.store import Workspace, filesystem

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").encode().translate(LOW))


# --- 3 ---


def unlike(n, boilerplate=60, own=40):
    """Texts that share most words, but are not similar."""
    common = " ".join(f"b{i}" for i in range(boilerplate))
    return [(i, common + " " + " ".join(f"u{i}x{j}" for j in range(own))) for i in range(n)]


def test_a_large_bucket_of_unlinked_texts(spark, monkeypatch):
    """Boilerplate fills buckets with texts of many components: rows stay in proportion, and the few true links are found."""
    monkeypatch.setattr(neardup, "MOST_BLOCKS", 0)
    rows = unlike(3000)
    rows += [(5000 + i, rows[10 * i][1] + f" extra{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {}
    put = Workspace.put

    def spy(self, df, name, compression="zstd"):
        out = put(self, df, name, compression)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "put", spy)
    monkeypatch.setattr(neardup, "confirm", lambda pairs, reps, docs, work, name: pairs.select("a", "b").limit(0))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert {d: c for d, c in got.items() if d != c} == {5000 + i: 10 * i for i in range(20)}
    assert made["rest-rare"] <= 30 * len(rows) and made["rest-held"] <= len(rows) and made["stars"] <= 64 * len(rows)


def test_a_large_star(spark, monkeypatch):
    """Thousands of near copies of one text: the centre is copied by block, and all are linked."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"q{i}"] + base[61:])) for i in range(2000)]
    monkeypatch.setattr(neardup, "STAR", 16)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("component_id <> 0 OR (kept AND doc_id > 0)")
    assert got.count() == 0


def test_rare_groups_meet_every_similar_pair(spark):
    """Two similar sets share a rare shingle of which the shorter is an index entry."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(8, 60)))] + [f"c{i}" for i in range(30)]
        for _ in range(6):
            own = [w for w in base if rng.random() > 0.02] + [f"x{rng.integers(1 << 30)}" for _ in range(int(rng.integers(0, 4)))]
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = neardup.rare_groups(docs.select("doc_id", F.col("doc_id").alias("label")), docs, Workspace(spark, "t"), "t").collect()
    members = {}
    for r in groups:
        members.setdefault(r.key, []).append((r.doc_id, r.index))
    met = {tuple(sorted((a, b))) for m in members.values() for a, i in m if i for b, _ in m if a != b}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [words(t)]}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links and links <= met


# --- 4 ---


def test_language_model_by_loops():
    """A step of the regression, and a prediction, one weight at a time."""
    rng = np.random.default_rng(3)
    model = langid.Ftrl(6, 3)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))

    def weight(i, k):
        if abs(z[i, k]) <= langid.L1:
            return 0.0
        return (math.copysign(langid.L1, z[i, k]) - z[i, k]) / ((langid.BETA + math.sqrt(n[i, k])) / langid.ALPHA + langid.L2)

    for _ in range(40):
        rows, label = rng.choice(6, 3, replace=False), int(rng.integers(3))
        x = rng.random(3)
        model.step(rows, x, label)
        w = [[weight(i, k) for k in range(3)] for i in rows]
        e = [math.exp(sum(x[j] * w[j][k] for j in range(3))) for k in range(3)]
        for j, i in enumerate(rows):
            for k in range(3):
                g = (e[k] / sum(e) - (k == label)) * x[j]
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / langid.ALPHA * w[j][k]
                n[i, k] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)

    texts = ["Grüße an 3 Leute", "ab", "", None, "1 2", "ab" * 5000, "Grüße an 3 Leute"]
    m = langid.Model(["xx", "yy"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]), 1.7)
    names, scores, letters = m.predict(pa.array(texts, pa.large_string()))
    for t, name, score, count, (idx, _) in zip(texts, names, scores, letters, langid.ngrams(pa.array(texts, pa.large_string())), strict=True):
        assert count == sum(c.isalpha() for c in t or "")
        if not count:
            assert (name, score) == ("und", 0.0)
            continue
        assert len(idx) == 3 * len(t) - 3 + (len(t) < 2)
        q = [math.exp((sum(float(m.weights[i, k]) for i in idx) / len(idx) + m.bias[k]) / 1.7) for k in range(2)]
        assert name == m.langs[int(q[1] > q[0])] and score == pytest.approx(max(q) / sum(q), rel=1e-4)


# --- 9 ---


@pytest.mark.parametrize("slices", [1 << 31, 2048])
def test_lm_score_by_counting(spark, monkeypatch, slices):
    """With so many hash functions that no probe is wrong, the score is that of quantised exact counts."""
    monkeypatch.setattr(ngramlm, "MOST_BITS", slices)
    monkeypatch.setattr(ngramlm, "PART", 200)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"t{min(int(rng.zipf(1.4)), 60)}" for _ in range(int(rng.integers(0, 40))))) for i in range(120)] + [(500, None), (501, "Never seen"), (502, "t1 T1 t2"), (502, "t1 T1 t2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)).withColumn("h", F.lit(1))
    got = ngramlm.score_documents(df, df.where("doc_id % 3 <> 0"), hashes=40).collect()
    single, double = Counter(), Counter()
    for d, t in rows:
        if d % 3:
            seq = ["<s>", *words(t), "</s>"]
            single.update(seq)
            double.update(zip(seq, seq[1:]))
    n, v = sum(c for w, c in single.items() if w != "<s>"), len(single) - 1
    level = lambda c: 0.0 if not c else 1.0 if c < 2 else 2 ** (int(math.log2(c)) + 0.5)
    want = Counter()
    for d, t in rows:
        seq, total = ["<s>", *words(t), "</s>"], 0.0
        for h, w in zip(seq, seq[1:]):
            ch, cw = level(single[h]), level(single[w])
            both = min(level(double[h, w]), ch, cw)
            total += math.log10((both + ngramlm.MU * (cw + 0.5) / (n + 0.5 * (v + 1))) / (ch + ngramlm.MU))
        want[d, round(total, 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want
    assert ngramlm.score_documents(df.limit(0), df).count() == 0


# --- 10 ---


def test_toxicity_by_loops():
    """The forward pass with one word, filter and place at a time."""
    rng = np.random.default_rng(4)
    f = lambda *s: rng.normal(size=s).astype(np.float32)
    m = toxicity.Model([f(n, toxicity.SIZE) for n in toxicity.TABLES], [f(w, toxicity.SIZE, toxicity.FILTERS) for w in toxicity.WIDTHS], [f(toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(size=toxicity.POOLS * toxicity.FILTERS * 3), 0.3)
    texts = ["one two (three) four!", "x", "", None, "one two (three) four!", "a b c d e f g " * 30]
    got = m.score(pa.array(texts, pa.string()))
    rows = [r for w, b in toxicity.word_rows(pa.array(texts, pa.string())) for r in (w[i:j] for i, j in zip(b[:-1], b[1:], strict=True))]
    for score, own in zip(got, rows, strict=True):
        x = [sum(m.tables[k][w[k]].astype(float) for k in range(4)) for w in own]
        z = m.bias
        for k, width in enumerate(toxicity.WIDTHS):
            for c in range(toxicity.FILTERS):
                values = sorted((sum(float(x[i + j] @ m.filters[k][j][:, c]) for j in range(width)) + float(m.offsets[k][c]) for i in range(len(x) - width + 1)), reverse=True)
                for p, value in enumerate(values[: toxicity.POOLS]):
                    z += max(value, 0) * m.out[(k * toxicity.POOLS + p) * toxicity.FILTERS + c]
        assert score == pytest.approx(1 / (1 + math.exp(-min(40, max(-40, m.slope * (z - m.thresholds[0]) + math.log(0.3 / 0.7))))), rel=1e-3, abs=1e-6)
    long = np.arange(40_000).reshape(-1, 4)
    taken = toxicity.spread(long)
    assert len(taken) == toxicity.WORDS and taken[0, 0] == 0 and taken[-1, 3] == 39_999 and len(toxicity.spread(long[:9])) == 9


def test_thresholds_count_all_labels():
    z, toxic, clean = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 1, 20, 30]), np.array([500, 30, 2, 0])
    best = toxicity.best_threshold(z, toxic, clean)
    f1 = {t: 2 * toxic[z > t].sum() / (toxic[z > t].sum() + clean[z > t].sum() + toxic.sum()) for t in (-1, 0.5, 1.5, 2.5)}
    assert best == max(f1, key=f1.get) == 1.5


# --- 5 ---


def plain_held(docs, items):
    """(doc, item) of exact copies by loops: a third of the item's windows of eight words, whole short items, lines of tiny ones."""
    trim = lambda w: w if len(w) < 2 else (w.strip(bytes(b for b in range(128) if not chr(b).isalnum())) or w[-1:])
    clean = lambda t: [trim(w) for w in words(t)]
    found = set()
    for i, q in items:
        w = clean(q)
        for d, t in docs:
            x = clean(t)
            if not w:
                continue
            if len(w) < decontaminate.ANYWHERE:
                hit = any(clean(line) == w for line in (t or "").split("\n"))
            else:
                size = min(len(w), decontaminate.WINDOW)
                own, there = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)], {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}
                hit = sum(k in there for k in own) >= decontaminate.SHARE * len(own)
            if hit:
                found.add((d, i))
    return found


def test_copies_of_every_length_and_case(spark):
    rng = np.random.default_rng(12)
    vocab = [f"wort{i}" for i in range(300)]
    items = [(-7 + n, " ".join(rng.choice(vocab, n))) for n in range(1, 20)] + [(100, "Eins zwei. Drei, VIER")]
    docs = [(n, " ".join(rng.choice(vocab, 30))) for n in range(60)]
    for k, (_, q) in enumerate(items):
        form = [str.upper, str.lower, str.title][k % 3]
        docs += [(1000 + k, " ".join(rng.choice(vocab, 9)) + " , " + form(q) + " . " + " ".join(rng.choice(vocab, 9))), (2000 + k, "first line\n" + form(q) + "\nlast line"), (3000 + k, q[: len(q) // 2])]
    docs += [(7777, None), (7778, ""), (None, items[-1][1])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("kind", F.lit("x"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, spark.createDataFrame([*items, (None, "a null id is an item of its own here too")], "item_id long, text string")).collect()}
    assert got == plain_held([d for d in docs if d[0] is not None], items)


def test_case_of_names(spark):
    """Names are told by capitals, which copies in other case lack."""
    q = "yesterday Anna Berta and Clara Dora met near Hamburg where Anna gave Clara the old book about Paris and Rome"
    docs = spark.createDataFrame([(1, q.lower()), (2, q.upper()), (3, q.replace("Anna", "Frieda").replace("Rome", "Bern")), (4, "nothing of it")], "doc_id long, text string")
    got = {r.doc_id: r.changed for r in decontaminate.contaminated(docs, spark.createDataFrame([(5, q)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_items_of_one_template(spark):
    """Items that differ in values are one template under the smallest id; an exact copy is still found by its own words."""
    q = "If a train leaves the station at {} and runs for {} hours then it arrives after {} hours in total"
    items = [(k, q.format(k + 3, k + 40, k + 40)) for k in range(30)]
    docs = [(100 + k, "so: " + q.format(900 + k, 700 + k, 700 + k)) for k in range(40)] + [(5, items[17][1])]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.changed) for r in found if r.doc_id >= 100} == {(100 + k, 0, True) for k in range(40)}
    assert (5, 17, False) in {(r.doc_id, r.item_id, r.changed) for r in found} and len(found) <= 45


# --- 6 and 8 ---


def test_damaged_archives():
    records = [warc.record(i, f"http://x/{i}", b"body %d" % i * 90, hashlib.sha1(b"body %d" % i * 90).hexdigest(), None) for i in range(40)]
    data = b"".join(warc.archive(warc.train(records), iter(records)))
    assert [warc.measured(h, b)[:3] for h, b in warc.read_archive(io.BytesIO(data))] == [(i, len(b"body %d" % i * 90), hashlib.sha1(b"body %d" % i * 90).hexdigest()) for i in range(40)]
    with pytest.raises(Exception):  # noqa: B017
        list(warc.read_archive(io.BytesIO(data[:-20])))
    swapped = warc.record(1, "http://x", b"another body", hashlib.sha1(b"the body").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        [warc.measured(h, b) for h, b in warc.read_archive(io.BytesIO(b"".join(warc.archive(b"", iter([swapped])))))]


def test_damaged_media(spark):
    payload = bytes(range(256)) * 90
    whole = ogg.store_samples(payload)
    torn = bytearray(whole)
    torn[len(whole) // 2] ^= 1
    rows = [(1, 5, whole), (2, 5, bytes(torn)), (3, None, None), (4, 0, b""), (5, 1, b"OggS"), (1, 5, whole)]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").withColumn("feature", F.lit("clash"))
    got = sorted(map(tuple, ogg.media_features(media).collect()), key=lambda r: r[0])
    assert got[0] == got[1] and got[0][2:5] == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    streams, _ = ogg.demux(whole)
    n = -(-len(payload) // ogg.PACKET)
    last = max(sum(len(payload[i : i + ogg.PACKET]) for i in range(k * ogg.PACKET, len(payload), 2 * ogg.PACKET)) for k in (0, 1))
    assert got[0][7] == f"streams=2;pages={sum(s.pages for s in streams)};packets={n};last_ms={round(last / ogg.RATE * 1000)};mean={sum(payload) * 1000 // len(payload)}"
    assert got[2][7].endswith("bad=1") and got[2][2] < len(payload)
    assert got[3][1:] == (None, None, None, None, None, None, "none") and got[4][2] == got[5][2] == 0
    assert ogg.media_features(media.limit(0)).count() == 0 and ogg.media_features(ogg.media_column(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_store_of_other_schemes():
    fs, path = filesystem("s3a://bucket/a/b")
    assert fs.type_name == "s3" and path == "bucket/a/b"
    assert filesystem("file:/a/b")[1] == filesystem("file:///a/b")[1] == filesystem("/a/b")[1] == "/a/b"


# --- pipeline ---


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus of two languages with everything that a stage rejects."""
    rng = np.random.default_rng(21)
    vocab = {"en": "the and with from this house water light stone river".split(), "de": "der und mit über nicht haus wasser licht stein fluss".split()}
    rows, labels = [], []
    for i in range(400):
        lang = ["en", "de"][i % 2]
        w = list(rng.choice(vocab[lang], 40)) + [f"{lang}{i}q{j}" for j in range(3)]
        if i % 5 == 0:
            w[3] = w[20] = w[30] = "scum"
        labels.append((i, int(i % 5 == 0), 1))
        rows.append((i, " ".join(w), lang, "s", 0))
    item = " ".join(f"frage{j}" for j in range(20))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 34 !", "de", "s", 0), (1003, "Широкая электрификация южных губерний даст толчок " * 8, None, "s", 0), (1004, "und mit", "de", "s", 0)]
    rows += [(2000 + k, clean[k][1], clean[k][2], "s", 0) for k in range(10)] + [(2100 + k, clean[20 + k][1] + " mehr", clean[20 + k][2], "s", 0) for k in range(10)]
    rows += [(3000, "the and with " + item.upper() + " from this house", "en", "s", 0), (3001, "river light", "en", "s", 0), (3001, "river light", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    for name, data, ddl in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, toxic int, quality int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, ddl).withColumn("kept", F.lit("own")).write.parquet(f"{folder}/{name}.parquet") if name == "documents" else spark.createDataFrame(data, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    import corpus_pipeline as cp

    folder, rows = corpus
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "toxicity", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    every = sorted(r[0] for r in rows)
    kept = stages["language_id"](spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == [i for i in every if i not in (1000, 1001, 1002, 1003)]
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == [i for i in every if i >= 400 or i % 5]
    clean = docs.where("doc_id >= 400 OR doc_id % 5 > 0")
    kept = stages["near_duplicates"](spark, clean, folder)
    sets = {d: ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()) for d, t, *_ in rows for w in [words(t)]}
    gone = {b for b in sets for a in sets if a < b and (a >= 400 or a % 5) and (b >= 400 or b % 5) and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert gone == set(range(2000, 2010)) | set(range(2100, 2110))
    assert kept.columns == docs.columns and ids(kept) == sorted({i for i in every if i >= 400 or i % 5} - gone)
    assert [r.kept for r in kept.select("kept").distinct().collect()] == ["own"]
    kept = stages["decontamination"](spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == [i for i in every if i != 3000]
    packed = stages["packing"](spark, docs, folder)
    assert Counter(r.doc_id for r in packed.collect()) == Counter(every)
    for stage in list(stages)[2:]:
        assert stages[stage](spark, docs.limit(0), folder).count() == 0


def test_pipeline(spark, corpus):
    import corpus_pipeline as cp

    folder, rows = corpus
    gone = {1000, 1001, 1002, 1003, 3000} | set(range(2000, 2010)) | set(range(2100, 2110))
    want = {r[0] for r in rows if (r[0] >= 400 or r[0] % 5) and r[0] not in gone}
    got = cp.run(spark, folder).toPandas()
    assert Counter(got.doc_id) == Counter(want)
    assert sorted(got.offset + got.length) and got.groupby("sequence_id").length.sum().max() <= 1024
