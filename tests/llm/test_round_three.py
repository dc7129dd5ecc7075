"""Fill-in-middle, SimHash and hard negatives against plain loops."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import LOW, ODD, WORD, docs, words

from latticeworks.llm import fim, hardneg, neardup, ngramlm, ogg, simhash
from latticeworks.llm.store import Workspace

# --- 11 ---

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [*ODD, *((100 + k, f"  the {k} quick 😀 brown\tfox\n jumps  over é it \n") for k in range(60)), (300, "a <S> marker"), (301, "<P>"), (302, "<M> b"), (303, "< P > < S"), (304, "  nbsp  "), (305, "$1 \\ $2 (x) [y] {2}"), (306, "word " * 200_000)]


def cut(doc_id, t):
    t = t or ""
    u = TOKEN.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 50:
        return (doc_id, len(u), "plain", t, None, None)
    form = "spm" if h4 % 100 < 80 else "psm"
    return (doc_id, len(u), form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", len(p), len(m))


def test_fill_in_middle(spark):
    df = docs(spark, TEXTS).withColumn("output", F.lit("clash")).withColumn("_a", F.lit(1))
    made = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert [c for c in made.columns if c in df.columns] == [c for c in df.columns if c not in ("output", "_a")] + ["output"]
    got = made.select("doc_id", *fim.ADDED[:3], "prefix_chars", "middle_chars", "text", "back").collect()
    want = [cut(*r) for r in TEXTS]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"} and all(r["text"] == r["back"] for r in got)
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 12 ---


def plain_print(t, width=3):
    w = WORD.findall((t or "").encode().translate(LOW))
    s = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reachable(nodes, near):
    """Of each node the least one reachable."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if near(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    got = {(r["doc_id"], r["fp"]) for r in simhash.fingerprints(docs(spark)).collect()}
    assert got == {(d, signed(plain_print(t))) for d, t in ODD}
    import pyarrow as pa

    assert list(simhash.text_fingerprints(pa.array(["A b\tC  d", None, "a b c d"]))) == [plain_print("a b c d"), 0, plain_print("a b c d")]


def crowd_of_prints(seed=3):
    """Random fingerprints, chains of close ones, and crowds that share one half of their bits."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(60)]
    for start in (0, (1 << 64) - 1, out[0]):
        x = start
        for _ in range(12):
            out.append(x)
            for k in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << k
    low, high = rng.getrandbits(32), rng.getrandbits(32) << 32
    out += [high | low ^ sum(1 << k for k in rng.sample(range(32), rng.choice([0, 1, 2, 3]))) for _ in range(60)]
    out += [low | high ^ sum(1 << k + 32 for k in rng.sample(range(32), rng.choice([0, 1, 2, 3]))) for _ in range(60)]
    return sorted(set(out))


@pytest.mark.parametrize(("count", "crowd"), [(2, 1), (2, 8), (2, 10_000), (3, 4), (4, 10_000)])
def test_links_by_all_pairs(spark, count, crowd):
    prints = crowd_of_prints()
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, Workspace(spark, "t"), count=count, crowd=crowd).collect()]
    near = lambda a, b: (a ^ b).bit_count() <= 2
    assert all(near(a, b) for a, b in found)
    seen = {frozenset(x) for x in found}
    if crowd == 10_000:
        assert seen == {frozenset(x) for x in combinations(prints, 2) if near(*x)}
    assert reachable(prints, near) == reachable(prints, lambda a, b: frozenset((a, b)) in seen)


def test_a_wide_radius_by_all_pairs(spark):
    prints = crowd_of_prints()[:90]
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(df, Workspace(spark, "t"), radius=4, crowd=10_000).collect()}
    assert found == {frozenset(x) for x in combinations(prints, 2) if (x[0] ^ x[1]).bit_count() <= 4}
    with pytest.raises(ValueError):
        simhash.links(df, Workspace(spark, "t"), radius=3)


@pytest.mark.parametrize("crowd", [1, 64])
def test_simhash_components(spark, crowd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    rows = list(ODD)
    for k in range(40):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 300])):
            own[rng.randrange(400)] = f"x{rng.randrange(99)}"
        rows.append((500 + k, " ".join(own)))
    rows += [(20, None), (21, "  "), (22, "joins"), (22, "two classes"), (23, "joins"), (24, "two classes")]
    made = simhash.near_duplicates(docs(spark, rows), crowd=crowd).collect()
    prints = {}
    for d, t in rows:
        if d is not None:
            prints.setdefault(d, set()).add(plain_print(t))
    want = reachable(set(prints), lambda a, b: any((x ^ y).bit_count() <= 2 for x in prints[a] for y in prints[b]))
    assert sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in made) == sorted((str(d), signed(plain_print(t)), want.get(d)) for d, t in rows)
    assert len({c for d, c in want.items() if d >= 500}) < 40
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 13 ---


def vectors(seed=2, n=260, size=24):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, size))
    rows = []
    for k in range(n):
        label = int(rng.integers(4))
        v = centre[label] * 0.3 + rng.standard_normal(size)
        rows.append([k, label, [float(x) for x in v / np.linalg.norm(v)]])
    for k in (3, 51, 100, 150):  # ties
        rows[k][2] = rows[0][2]
    rows[7][1] = rows[8][2] = None
    rows[9][2] = [float("nan"), *rows[9][2][1:]]
    rows[10][2] = [float("inf"), *rows[10][2][1:]]
    rows[11][2] = [None, *rows[11][2][1:]]
    rows[12][2], rows[13][2], rows[14][2] = [], [0.5], [0.0] * size
    rows += [rows[20], rows[50], [21, 3, rows[22][2]], [50, 9, rows[23][2]], [None, 1, rows[24][2]]]
    return [tuple(r) for r in rows]


def plain_negatives(rows):
    ok = [(i, l, [int(np.floor(256 * x)) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in ok:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    out = set()
    for i, (l, v) in anchors.items():
        score = lambda w, v=v: sum(x * y for x, y in zip(v, w, strict=False))
        same = sorted({(-score(w), j) for j, m, w in ok if m == l and j != i})[:5]
        other = sorted({(-score(w), j) for j, m, w in ok if m != l and j != i})
        for p, j in same:
            fits = [(-s, k) for s, k in other if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out |= {(i, j, n + 1, k, -p, s) for n, (s, k) in enumerate(fits)}
    return out


@pytest.mark.parametrize("slab", [1 << 20, 50])
def test_hard_negatives(spark, slab):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit("r"), "x": F.lit(0)})
    got = [tuple(r) for r in hardneg.hard_negatives(df, slab_values=slab).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows)
    assert hardneg.hard_negatives(df.limit(0)).count() == 0


def test_intervals_hold_and_filter(monkeypatch):
    """Every interval holds its product, and most rows are left out; so results do not rest on the filter."""
    rng = np.random.default_rng(0)
    for size in (1, 7, 64, 100):
        x = np.floor(256 * rng.standard_normal((500, size)) / np.sqrt(size)).astype(np.int64)
        x[3] = 0
        x[4] *= 1_000_000
        a = hardneg.Anchors(np.arange(40), np.zeros(40, int), x[:40])
        estimate, far = a.interval(slice(0, 40), *hardneg.encode(x))
        assert (np.abs(estimate - x[:40] @ x.T) <= far).all()
        if size == 64:
            out = estimate + far < 0.45 * a.norm[:, None] * a.norm[:, None]
            assert out[5:].mean() > 0.9


# --- 3: documents with several sets ---


def similar(x, y):
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            sets.setdefault(d, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return reachable(list(sets), lambda a, b: any(similar(x, y) for x in sets[a] for y in sets[b]))


def story(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def edited(text):
    return [*text[:-3], "a", "b", "c"]


@pytest.mark.parametrize("turn", [1, -1])
@pytest.mark.parametrize("shift", [0, (1 << 62) + 5])
def test_documents_with_several_sets(spark, turn, shift):
    """Links of every set of a document count, whatever the order of rows."""
    a, b, c, d, e = (story(k) for k in range(5))
    s = " ".join
    rows = [(1, s(a)), (2, s(b)), (5, s(edited(a))), (5, s(edited(b))), (11, s(c)), (11, s(d)), (12, s(edited(c))), (13, s(edited(d))), (20, s(e)), (20, None), (20, s(e)), (21, ""), (22, s(story(9))), (22, s(story(10))), (40, s(edited(e)))]
    rows = [(k + shift, t) for k, t in rows][::turn]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain_components(rows)
    assert got == {(k, c, k == c) for k, c in want.items()}
    assert {k - shift: c - shift for k, c in want.items()} == {1: 1, 2: 1, 5: 1, 11: 11, 12: 11, 13: 11, 20: 20, 21: 21, 22: 22, 40: 20}


# --- 2: tags ---


def test_tags_by_attribute(spark):
    """What only looks like a link is none; quotes hold >; rules see every URL as written. The SQL agrees."""
    import duckdb

    from latticeworks.llm import urlfilter

    bad = "http://z.org/es/5"
    htmls = {
        1: (f'<link rel="stylesheet" data-rel="canonical" href="{bad}">', "allow"), 2: (f"<!-- <link rel=canonical href='{bad}'> -->", "allow"), 3: (f"<link title='a>b' rel='canonical' href='{bad}'>", "block"),
        4: (f'<LINK HREF="{bad}" REL="alternate Canonical"/>', "block"), 5: (f"<link rel=canonical data-href='http://q.edu/' href={bad}>", "block"), 6: (f"<link title=\"rel='canonical'\" href='{bad}'>", "allow"),
        7: (f"<script>var a = \"<link rel='canonical' href='{bad}'>\";</script>", "allow"), 8: (f"<link rel=canonical><link rel=canonical href='{bad}'>", "block"), 9: (f"<linker rel=canonical href='{bad}'>", "allow"),
        10: (f"<!-- open <link rel=canonical href='{bad}'>", "allow"), 11: (f"<meta content='5; URL=\"{bad}\"' http-equiv='Refresh'>", "block"), 12: (f"<meta http-equiv=refresh content='text url={bad}'>", "allow"),
        13: (f"<link rel='canonical' rel='x' href=\"{bad}\" href='http://q.edu/'>", "block"), 14: (f"<link rel\n=\n'canonical'\nhref = '{bad}'\n>", "block"), 15: ("<link rel=canonical href='http://z&#46;org/'>", "allow"),
        16: ("<link rel='canonical' href='http://k.edu/a?x=1&amp;y=2'>", "block"), 17: (f"<link rel=canonical href='http://k.edu/a'><link rel=canonical href='{bad}'>", "block"), 18: (f"<link rel=canonical {'x' * 200_000} {'a=b ' * 30_000} href='{bad}'>", "block"), 19: ("<link rel=canonical href=''>", "allow"),
    }
    rows = [(k, f"http://host{k}.edu/p", h) for k, (h, _) in htmls.items()]
    rows += [(50, "http://k.edu/a", f"<link rel=canonical href='{bad}'>")]
    # a page as written is allowed, its node is not named by a rule
    rows += [(60, "http://a.net/de/../x", f"<link rel=canonical href='{bad}7'>"), (61, "http://o.edu/y", "<link rel=canonical href='http://a.net/x'>"), (62, None, "x"), (63, "none", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert {r[0]: r[4] for r in got} == {k: v for k, (_, v) in htmls.items()} | {50: "block", 60: "allow", 61: "allow", 62: "allow", 63: "allow"}
    c = duckdb.connect()
    c.register("pages", pages.toArrow())
    assert set(c.sql(urlfilter.ORACLE).fetchall()) == got


# --- 5: short questions, classes, names in any case, several passes ---


def test_short_questions_with_other_values(spark, monkeypatch):
    from latticeworks.llm import decontaminate

    items = [(1, "What is 7 times 8?"), (2, "Solve 2 + 3 x = 11"), (3, "What is 5 times 9?"), (4, "so Anna has 3 apples and Bob has 6 apples and then they both eat one apple each day"), (5, "What is 4 times 4?"), (6, "3 5 7 9")]
    docs = [
        (1, "Let us see. What is 12 times 13? That is easy."), (2, "Now.\nSolve 4 + 5 x = 19\nand so on"), (3, "So anna has 4 apples and bob has 8 apples and then they both eat one apple each day or so"), (4, "What is it and 4 times more of 13 he said"), (5, "What is 9 times 9?"),
        (6, "before it: what is 7 times 8 and more"), (7, "1 2 3 4 5 6"), (8, "Solve 4 + 4 x = 19"), (9, None),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(1, 1, True, 1), (2, 2, True, 2), (3, 4, True, 4), (5, 5, True, 5), (6, 1, False, 1)}
    for bits in (decontaminate.MOST_BITS, 1 << 7):
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)  # few bits: several passes
        got = {(r.doc_id, r.item_id, r.changed, r.class_id) for r in decontaminate.contaminated(rows, table).collect()}
        assert got == want
    assert {tuple(r) for r in decontaminate.template_classes(table).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6)}


def brute_templates(item, text):
    """Of a template the copies in a text by loops: {value: value} of each place where the words fit and values are bound one to one."""
    units, word = set(__import__("latticeworks.llm.decontaminate", fromlist=["UNITS"]).UNITS), re.compile(r"[^\s]+")

    def slots(t):
        out = []
        for m in word.finditer(t):
            w = m.group().strip(".,!?:;\"'()") or m.group()
            opening = not out or t[: m.start()].rstrip(" ")[-1:] in ".!?:;\n\"([{"
            kind = 1 if w[0].isdigit() else 3 if out and out[-1][0] == 1 and w.lower() in units else 2 if w[0].isupper() and not opening and len(w) > 1 and not w[1].isupper() else 0
            out.append((kind, w.lower()))
        return out

    q, d, found = slots(item), slots(text), []
    for i in range(len(d) - len(q) + 1):
        here = d[i : i + len(q)]
        if all(a[0] == b[0] and (a[0] or a[1] == b[1]) for a, b in zip(q, here, strict=True)):
            pairs = {(a[1], b[1]) for a, b in zip(q, here, strict=True) if a[0]}
            if len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):
                found.append(dict(pairs))
    return found


def test_copies_with_other_values_by_loops(spark):
    """Whole copies with values bound one to one, and those whose values are not, of items of 4 to 7 words."""
    from latticeworks.llm import decontaminate

    rng = random.Random(4)
    forms = ["Take {} of {}", "Add {} and {} to {}", "How many is {} less {}", "Give {n} the {} then {}", "We saw {n} buy {} more pens", "Put {} km beside {} km now", "The sum of {} with {} equals {}"]
    fill = lambda f: re.sub(r"\{n?\}", lambda m: rng.choice(["Anna", "Bert", "Clara"]) if m.group() == "{n}" else str(rng.randrange(3, 8)), f)
    items = [(k, fill(f)) for k, f in enumerate(forms)]
    docs = [(100 + k, f"A first line.\n{fill(rng.choice(forms))}.\nA last line.") for k in range(120)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, q in items if brute_templates(q, t)}
    assert got == want and 20 < len(want) < 120


# --- 8 ---


def test_packet_times(spark):
    """Every packet of a file has the time at which its samples lie; of a damaged one those that are left keep theirs."""
    payload = bytes(k * 7 % 251 for k in range(ogg.PACKET * 41 + 384))
    whole = ogg.store_samples(payload)
    want = []
    for k, at in enumerate(range(0, len(payload), ogg.PACKET)):
        stream, packet, n = k % 2, k // 2, len(payload[at : at + ogg.PACKET])
        start = packet * ogg.PACKET
        want.append((stream, packet, n, start * 1000 / ogg.RATE, (start + n) * 1000 / ogg.RATE))
    pages = [m.start() for m in re.finditer(b"OggS", whole)]
    torn = bytearray(whole)
    torn[pages[6] + 40] ^= 1
    rows = [(1, whole), (2, bytes(torn)), (3, None), (4, b""), (1, whole)]
    media = spark.createDataFrame(rows, "doc_id long, media binary").withColumn("stream", F.lit("clash"))
    got = [tuple(r) for r in ogg.packet_times(media).collect()]
    assert sorted(r[1:] for r in got if r[0] == 1) == sorted(2 * want) and {r[0] for r in got} == {1, 2}
    left = [r[1:] for r in got if r[0] == 2]
    assert 0 < len(left) < len(want) and {(r[0], *r[2:]) for r in left} <= {(r[0], *r[2:]) for r in want}
    assert ogg.packet_times(media.limit(0)).count() == 0


def test_page_that_ends_a_cut_packet():
    """Its position is that of the cut packet, not of the last one that was kept."""
    packets, ends = [b"first", bytes(300), bytes(255 * 90), bytes(10)], [0, 300, 300 + 255 * 90, 310 + 255 * 90]
    pages = list(ogg.stream_pages(1, packets, ends, segments=64))
    lost = b"".join(pages[:1] + pages[2:])
    (stream,), _ = ogg.demux(lost)
    assert stream.packets == [packets[0], packets[3]] and stream.granules == [0, ends[3]]
    (stream,), _ = ogg.demux(b"".join(pages[:1]) + b"".join(pages[1:2]))
    assert stream.packets == packets[:2] and stream.ends(len) == [0, 300]


# --- 9 ---


def test_lm_words_in_slices(spark, monkeypatch):
    """Scores do not depend on how many slices the filters of words and pairs come in."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randrange(50)))) for i in range(90)] + [(500, None), (501, ""), (502, "w1 Unseen w2"), (502, "w1 Unseen w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)).withColumn("level", F.lit("clash")).coalesce(2)
    monkeypatch.setattr(ngramlm, "PART", 64)
    loaded, got = [], []
    load = ngramlm.load_filter
    monkeypatch.setattr(ngramlm, "load_filter", lambda built, parts, span, hashes: loaded.append((parts, span)) or load(built, parts, span, hashes))
    for bits in (1 << 31, 1024):
        monkeypatch.setattr(ngramlm, "MOST_BITS", bits)
        made = ngramlm.score_documents(df, df.where("doc_id % 3 <> 0")).collect()
        got.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in made))
        if bits > 1024:
            assert len(loaded) == 2 and loaded[0][0] < loaded[1][0]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    words, pairs = loaded[0][0], loaded[1][0]
    spans = [span for parts, span in loaded[2:] if parts == words]
    assert len(spans) > 1 and [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and sum(parts == pairs for parts, _ in loaded[2:]) > 1
