"""The operators on small hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import decontaminate, langid, neardup, ngramlm, ogg, packing, separators, text, tokens, toxicity, urlfilter, warc
from latticeworks.llm.components import components
from latticeworks.llm.store import Workspace, filesystem

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977} {i}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, LONG), (6, LONG), (None, "no id here at all"), (7, "x" * 3000), (8, "Größe ça 7 <|endoftext|> a  b"), (9, "1 2 3 !")]


def docs(spark, rows=ODD):
    """With columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit(1), "key": F.lit("k"), "h": F.lit(2), "kept": F.lit("no")})


def words(t):
    return WORD.findall((t or "").encode().translate(LOW))


# --- text ---


def test_words_and_shingles():
    import pyarrow as pa

    rows = [t for _, t in ODD] * 3
    at = 0
    for _, hashes, bounds in text.hashed_words(pa.array(rows, pa.string())):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = words(rows[at])
            assert b - a == len(own)
            seen = dict(zip(own, hashes[a:b].tolist(), strict=True))
            assert all(seen[w] == h for w, h in zip(own, hashes[a:b].tolist(), strict=True)) and len(set(seen.values())) == len(seen)
            at += 1
    assert at == len(rows)
    for t, s in zip(rows, text.shingle_sets(pa.array(rows, pa.string())), strict=True):
        w = words(t)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(s) == len(want)


# --- 1 and 7 ---


def test_encoder_equals_the_json_vocabulary():
    enc = tokens.encoder()
    rng = np.random.default_rng(0)
    alphabet = list("ab é1.,'\n  \t s<|>Zßñ漢")
    for t in [t for _, t in ODD if t] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]:
        assert enc.encode(t).tolist() == enc.full.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [3, 1000, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want, sizes = [], []
    for f in range(3):
        ids = rng.integers(0, 60, rng.integers(0, 500)).astype("<u2")
        ids[ids > 50] = separators.END
        path = f"file://{tmp_path}/f{f}.bin"
        (tmp_path / f"f{f}.bin").write_bytes(ids.tobytes())
        sizes.append((path, ids.nbytes))
        start = 0
        for n, end in enumerate(np.flatnonzero(ids == separators.END).tolist() + ([len(ids)] if len(ids) and ids[-1] != separators.END else [])):
            want.append((f"f{f}", n, start, end - start, end < len(ids)))
            start = end + 1
    found = separators.scan_separators(spark.createDataFrame(sizes, "path string, bytes long"), Workspace(spark, "t"), 2, block=block)
    got = [(r.path.rsplit("/", 1)[1][:-4], r.ordinal, r.start, r.n_tokens, r.closed) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_token_counts_of_documents(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_tokens) for r in separators.op1_token_separators(spark, str(tmp_path)).collect())
    enc = tokens.encoder()
    assert got == Counter((d, len(enc.encode(t, special=False))) for d, t in ODD)
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert separators.op1_token_separators(spark, str(tmp_path / "none")).count() == 0


def test_fill_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.arange(1, 40), 5, replace=False)}
        chosen = packing.fill(counts, 60)
        reach = {0}
        for k, n in counts.items():
            reach = {x + k * j for x in reach for j in range(n + 1)}
        assert sum(k * n for k, n in chosen.items()) == max(x for x in reach if x <= 60) and all(n <= counts[k] for k, n in chosen.items())


def test_packing(spark):
    rows = ODD + [(100 + i, "w " * (i * 13 % 700)) for i in range(300)] + [(1000 + i, "same length here") for i in range(1500)]
    got = packing.pack_documents(docs(spark, rows)).toPandas()
    enc = tokens.encoder()
    ids = [(d, np.append(enc.encode(t).astype("<u4"), np.uint32(0))) for d, t in rows]
    want = Counter((d if d is not None else -1, a, len(x[a : a + 1024]), zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for d, x in ids for a in range(0, len(x), 1024))
    own = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))
    assert Counter(own[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == want
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= 1024 and (1024 - total).sum() < 1024 + 0.01 * total.sum()
    assert packing.pack_documents(docs(spark, [])).count() == 0


# --- 2 ---


def test_url_filter(spark):
    rows = [
        (1, "http://A.example.com/en/1?x", '<link rel="canonical" href="https://b.example.org/fr/2#y">'), (2, "https://b.example.org/fr/2", ""), (3, "https://q.example.org/fr/9", "<META http-equiv=refresh content='0; url=/es/4'>"),
        (4, None, "x"), (5, "nothing", None), (6, "http://z.example.net/fr/1", '<meta http-equiv="refresh" content="3;URL=//d.example.com/en/71">'), (7, "http://z.example.net/fr/1#q", '<link href="http://spam.org/es/" rel="canonical">'),
        (8, "http://example.com/en/7", None), (9, "http://m.net/de/8", ""), (9, "http://m.net/de/8", ""), (None, "https://x.example.net/de/88", ""),
    ]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("?"))).collect()}
    assert got == {
        (1, "a.example.com", "/en/1", "com/en/", "block"), (2, "b.example.org", "/fr/2", None, "block"), (3, "q.example.org", "/fr/9", None, "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "z.example.net", "/fr/1", None, "allow"), (7, "z.example.net", "/fr/1", None, "allow"), (8, "example.com", "/en/7", "example.com/en/7", "allow"), (9, "m.net", "/de/8", "net/de/", "allow"), (None, "x.example.net", "/de/88", "example.net/de/8", "block"),
    }
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_targets(spark):
    """Queries that hold a URL, dot segments, other schemes and empty paths; the SQL agrees."""
    link = "<link rel=canonical href='{}'>".format
    rows = [
        (1, "http://good.example.edu/a", link("/go?next=http://spam.org/es/1")), (2, "http://q.org/fr/a/b", link("../../es/9")), (3, "http://r.org/fr/./x", link("HTTPS://R.org/es/./y/../z")),
        (4, "http://m.edu/x", link("mailto:a@spam.org/es/1")), (5, "http://m.edu/y", link("javascript:go")), (6, "http://b.org", link("//c.org/es/")), (7, "http://d.edu/u", link("http://b.org/")),
        (8, "http://up.edu/a", link("../../../b")), (9, "http://up.edu/b", link("http://t.org/es/../es/..")), (10, "http://t.org/", ""), (11, "http://h.edu/p", link("#top")), (12, "http://h.edu/" + "p" * 30000, link("q" * 30000)),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert {r[0]: r[4] for r in got} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow"}
    import duckdb

    c = duckdb.connect()
    c.register("pages", pages.toArrow())
    assert set(c.sql(urlfilter.ORACLE).fetchall()) == {(r[0], r[1], r[2], r[3], r[4]) for r in got}


def test_long_rule_lists(spark):
    """A list that is joined gives what the same list as an expression gives."""
    hosts = ["a.com", "b.a.com", "com", "org", "x.org", "y.x.org"]
    rules = [(h, p, v) for i, h in enumerate(hosts) for j, p in enumerate(["/", "/en/", "/en/7", "/" + "z" * 9000]) for v in [["block", "allow"][(i + j) % 2]]] + [("com", "/en/", "allow")]
    rows = [(i, f"http://{h}{p}", None) for i, (h, p) in enumerate((h, p) for h in [*hosts, "c.b.a.com", "edu", ""] for p in ["", "/", "/en", "/en/", "/en/71", "/de", "/" + "z" * 9001])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, urlfilter.judge(pages, rules).collect()), key=repr)
    table = spark.createDataFrame(rules, "host string, prefix string, verdict string")
    assert sorted(map(tuple, urlfilter.judge(pages, table).collect()), key=repr) == want


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {x: root(x) for x in parent}


# --- 3 ---


def brute_duplicates(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(d for d in sets if d is not None)
    label = {d: d for d in ids}
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d], label[d] == d) for d in ids}


def near_copies(seed=0, groups=12, size=9):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(4, 90)))]
        for _ in range(size):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = f"x{int(rng.integers(1 << 30))}"
            rows.append((len(rows) + 100, " ".join(own)))
    return rows


def test_near_duplicates(spark):
    rows = [r for r in ODD if r[0] not in (None, 6)] + [(6, LONG), (60, LONG)] + near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_duplicates(rows)


def test_leftover_links_inside_buckets(spark, monkeypatch):
    """Links that no star has: entries are compared in blocks, and only links come out."""
    rows = near_copies(5, 6, 20)
    monkeypatch.setattr(neardup, "confirm", lambda pairs, reps, docs, work, name: pairs.select("a", "b").limit(0))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {d: x[1] for d, x in brute_duplicates(rows).items()}


def test_near_duplicates_defined_cases(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "q"), (2, "r s t u v w"), (3, "r s t u v w"), (4, None), (5, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert got == Counter([(None, 2, None, True)] * 2 + [(1, 2, 1, True), (2, 1, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 0, 4, True), (5, 0, 5, True)])
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


# --- 4 and 10 ---


def speech(seed=1, n=160):
    rng = np.random.default_rng(seed)
    parts = {"en": ["the", "and", "with", "from", "this"], "de": ["der", "und", "mit", "über", "nicht"], "fr": ["le", "et", "avec", "être", "pas"]}
    return [(i, " ".join(rng.choice(parts[lang], 25)), lang) for i in range(n) for lang in [sorted(parts)[i % 3]]]


def test_language(spark):
    rows = speech() + [(1000, None, "en"), (1001, "", None), (1002, "12 !?", "de"), (1003, "the and with", None), (None, "der und", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df.where(~langid.is_held_out(0, 5)))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in speech())
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred == "en"
    none = langid.fit(df.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i, t, lang in speech(7, 500):
        bad = i % 4 == 0
        w = t.split()
        if bad:
            w[int(rng.integers(len(w)))] = str(rng.choice(["scum", "scum!", "lowlif" + str(rng.integers(1000))]))
        rows.append((i, " ".join(w), lang))
        labels.append((i, int(bad)))
    rows += [(2000, None, "en"), (2001, "", None), (None, "scum", "en"), (2002, LONG, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("toxic_score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    train = ~toxicity.is_held_out()
    model = toxicity.fit(df.where(train), marks.where(train))
    got = {r.doc_id: r.toxic_score for r in toxicity.predict(df, model).collect()}
    truth = dict(labels)
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 4 == 2)
    assert right >= 0.97 * sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in truth)
    assert all(0 <= s <= 1 for s in got.values()) and got[2000] < toxicity.THRESHOLD and got[2000] == got[2001]
    one = toxicity.fit(df, marks.where("toxic = 0"))
    assert {r.toxic_score for r in toxicity.predict(df, one).collect()} == {0.0}


# --- 5 ---


def test_decontamination(spark):
    q = "When Anna bought 12 apples for 30 dollars in town, then Anna gave 12 apples to the old baker."
    rows = [
        (1, "so we know. " + q), (2, q.replace("Anna", "Bert").replace("12", "7").replace("30", "9") + " ok"), (3, "When Bert bought 7 apples for 9 dollars. Nothing else of it is here, so let it be."),
        (4, None), (5, ""), (None, q), (6, LONG), (7, "A clean text of many words that has nothing to do with any of those questions at all."), (8, LONG + " " + q.upper().lower() + " " + LONG), (8, "again"), (9, "before it five words make it short after it"),
    ]
    items = spark.createDataFrame([(1, q), (1, q), (2, "five words make it short"), (3, None), (4, ""), (5, "too short")], "item_id long, text string").withColumn("windows", F.lit(1))
    got = {(r.doc_id, r.item_id): r.changed for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert {(1, 1), (2, 1), (9, 2)} <= set(got) <= {(1, 1), (2, 1), (8, 1), (9, 2)} and got[(2, 1)] and not got[(1, 1)]
    assert decontaminate.contaminated(docs(spark, []), items).count() == 0 and decontaminate.contaminated(docs(spark, rows), items.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    q = "First take 3 red cubes and 5 blue balls from the box then put 3 red cubes on top of 5 blue balls again"
    rows = [(1, q.replace("3", "8").replace("5", "6")), (2, "First take 1 red cubes and 2 blue balls from the box then put 8 red cubes on top of 9 blue balls again")]
    items = spark.createDataFrame([(1, q)], "item_id long, text string")
    got = {r.doc_id: r.matched for r in decontaminate.contaminated(docs(spark, rows), items, 0.0).collect()}
    assert got[1] == len(q.split()) - 7 and got.get(2, 0) < got[1]


# --- 6 ---


def test_warc(spark, tmp_path):
    big, other = "<p>" + "hello world " * 200, "<p>" + "bye " * 500
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "http://c/\n", "small"), (5, "http://d/", "small"), (6, "http://e/", other), (6, "http://e/", other), (None, "http://f/", big), (7, "ü", "é" * 600), (8, "ü", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6_warc_archive(spark, str(tmp_path)).collect())
    want = Counter()
    last = {big: 2, other: 6}
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h in last and p != last[h]
        want[(p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None)] += 1
    assert got == want
    pages.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op6_warc_archive(spark, str(tmp_path / "none")).count() == 0


def test_archive_bytes():
    import io

    import zstandard

    records = [warc.record(i, f"http://x/{i}", f"payload {i} of many".encode() * 30, hashlib.sha1(b"%d" % i).hexdigest(), None) for i in range(300)]
    dictionary = warc.train(records)
    data = b"".join(warc.archive(dictionary, iter(records)))
    assert data[:4] == warc.SKIPPABLE and int.from_bytes(data[4:8], "little") == len(dictionary) and data[8 : 8 + len(dictionary)] == dictionary
    back = [(h["x-page-id"], b) for h, b in warc.read_archive(io.BytesIO(data))]
    assert back == [(str(i), f"payload {i} of many".encode() * 30) for i in range(300)]
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
    assert own.decompress(data[8 + len(dictionary) :]) == records[0]


# --- 8 ---


def test_ogg_pages():
    def slow_crc(page):
        crc = 0
        for b in page:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 4000):
        raw = rng.bytes(n)
        assert ogg.page_crc(raw) == slow_crc(raw)
    sizes = [0, 1, 254, 255, 256, 510, 16320, 16321, 70000, 3]
    streams = [(9, [rng.bytes(s) for s in sizes], list(range(0, 10 * len(sizes), 10))), (5, [b"head", b"", rng.bytes(300)], [0, 0, 7])]
    data = ogg.mux(streams)
    got, bad = ogg.demux(b"junk" + data)
    assert bad == 0 and [(s.serial, s.packets) for s in got] == [(s, p) for s, p, _ in streams] and all(s.ended for s in got)
    assert got[0].seconds(10) == 9.0
    torn = bytearray(data)
    torn[len(data) // 2] ^= 1
    got, bad = ogg.demux(bytes(torn))
    assert bad >= 1 and set(got[0].packets) <= set(streams[0][1]) | {b""}


def test_ogg_column(spark):
    got = ogg.media_features(ogg.media_column(docs(spark))).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    for d, t in ODD:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(ogg.store_samples(payload)), hashlib.sha256(ogg.store_samples(payload)).hexdigest())


# --- 9 ---


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_lm(spark, monkeypatch, head):
    monkeypatch.setattr(ngramlm, "HEAD", head)
    rows = ODD + [(20 + i, f"the cat sat on mat {i % 7}") for i in range(60)]
    df = docs(spark, rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    got = ngramlm.score_documents(df.withColumn("held_out", held), df.where(~held)).collect()
    count = Counter(w for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for w in [*words(t), b"\n"])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t in rows:
        w = [*words(t), b"\n"]
        want[(d, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    own = [r for r in got if r.doc_id and r.doc_id >= 20]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    nothing = ngramlm.score_documents(df.withColumn("held_out", held), df.limit(0)).collect()
    assert {(r.train_tokens, r.n_known) for r in nothing} == {(0, 0)}


def test_filter_counts():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    c = np.minimum(rng.zipf(1.6, len(h)), 10**6)
    parts = 4
    made = [(p, *ngramlm.build_part(h[h.view(np.int64) % parts == p], c[h.view(np.int64) % parts == p], 1 << 30)) for p in range(parts)]
    f = ngramlm.CountFilter.of(parts, made)
    got = f.count(h)
    level = ngramlm.levels(c)
    low = np.where(level > 1, 2.0 ** (level - 0.5), 1.0)
    assert (got >= low).all() and (got == low).mean() > 0.9
    assert (f.count(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.1


def test_store(spark):
    fs, path = filesystem(Workspace(spark, "t").path)
    assert path.startswith("/") and fs.type_name == "local"
