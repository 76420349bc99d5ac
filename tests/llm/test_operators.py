"""The corpus operators against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import chat, decontaminate, html, lm, media, near_dedup, quality, segmentation, suffix_dedup, token_counts
from tidemark.llm.components import components
from tidemark.llm.pieces import DEFAULT_MODEL, pretokens, vocabulary
from tidemark.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k * k % 977}" for k in range(9000))
PASSAGE = "the quick brown fox jumps over the lazy dog while eleven ravens count their silver coins"
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (3, f"some text before. {PASSAGE} and some after"),
    (4, f"another start here, {PASSAGE} then the end"),
    (5, ""),
    (6, None),
    (7, " \n\t "),
    (8, LONG),
    (9, LONG[:-5]),
    (10, "ééé ☃ ▁mark 😀 ß"),
    (11, "two words"),
    (11, "two words"),
    (12, "aaaa" * 60),
    (None, PASSAGE),
    (None, None),
]
SCHEMA = "doc_id long, text string, batch string, digit int, rep double, key string, component string, n int, a int, b int"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0, None, "c", 0, 1, 2) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def removed(rows, length):
    key = lambda i: math.inf if i is None else i
    owner = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            owner[b[p : p + length]] = min(owner.get(b[p : p + length], math.inf), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if owner[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_bytes", [8 << 20, 3000])
def test_suffix_dedup_equals_brute_force(docs, batch_bytes):
    got = suffix_dedup.kept_digests(docs, batch_bytes=batch_bytes).collect()
    assert sorted(map(tuple, got), key=str) == removed(ROWS, 50)
    assert suffix_dedup.kept_digests(docs.limit(0)).count() == 0


def test_suffix_dedup_on_documents(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    for length, gram in ((50, 16), (99, 48)):
        got = suffix_dedup.kept_digests(small, length=length, gram=gram).collect()
        assert sorted(map(tuple, got), key=str) == removed(rows, length)


@pytest.mark.parametrize(("batch_bytes", "hot"), [(4 << 20, 512), (2000, 512), (2000, 2)])
def test_suffix_dedup_decides_on_bytes(spark, batch_bytes, hot):
    r = np.random.default_rng(3)
    core = "".join(map(chr, r.integers(97, 101, 400)))
    rows = [(f"d{k:02}", core[: 40 + 9 * k] + "".join(map(chr, r.integers(97, 123, 60))) + core[k * 7 :]) for k in range(40)]
    rows += [("d05", "another row of an id that is there, " + core[100:190]), (None, core[:80]), (None, core[:80]), ("a", "a" * 300), ("b", "a" * 120 + "b" + "a" * 49)]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id string, text string, number int, batch string")
    want = {}
    owner = {}
    key = lambda i: (i is None, i or "")
    for i, t in rows:
        for p in range(len(t) - 49):
            owner[t[p : p + 50]] = min(owner.get(t[p : p + 50], (True, "~")), key(i))
    for n, (i, t) in enumerate(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if owner[t[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        want[n] = (i, sum(gone), hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest())
    spans = suffix_dedup.removed_spans(docs, batch_bytes=batch_bytes, hot=hot, carry=("number", "batch"))
    assert {(x.number, x.batch) for x in (r.rest for r in spans.collect())} == {(1, "n")}
    got = [(x.doc_id, x.n_removed, x.kept_sha256) for x in suffix_dedup.kept_digests(docs, batch_bytes=batch_bytes, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want.values(), key=str)


def linked(rows, width, percent):
    ids = sorted({i for i, t in rows if i is not None})
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, width))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_equals_brute_force(docs, small, width, percent):
    for table, rows in ((docs, ROWS), (small, [(r.doc_id, r.text) for r in small.collect()])):
        got = near_dedup.NearDedup(width, percent).run(table).collect()
        want = linked(rows, width, percent)
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
        assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, width)) for _, t in rows)
    assert near_dedup.NearDedup(width, percent).run(docs.limit(0)).count() == 0


def test_near_dedup_finds_chains_and_truncated_copies(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[: 400 - 12 * k])) for k in range(20)] + [(100 + k, " ".join(words[:200] + [f"x{k}_{j}" for j in range(200)])) for k in range(20)]
    got = near_dedup.NearDedup(3, 85).run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(rows, 3, 85)


def test_near_dedup_ids(spark):
    """Ids that are strings, and an id whose rows tie two classes together."""
    words = [f"w{k}" for k in range(60)]
    rows = [("b", " ".join(words)), ("a", " ".join(words).upper()), ("c", " ".join(words[:30])), ("b", " ".join(words[:30])), ("d", "x " + " ".join(words)), (None, " ".join(words)), ("e", None)]
    got = near_dedup.NearDedup(3, 85).run(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([("b", "a", False), ("a", "a", True), ("c", "a", False), ("b", "a", False), ("d", "a", False), (None, None, True), ("e", "e", True)], key=str)


def test_bayes_bound_grows_with_what_was_seen():
    least = [near_dedup.fewest_matches(0.85, n, 1e-6) for n in (25, 50, 125)]
    assert least == sorted(least) and 0 < least[0] < 25 and least[2] > 70
    assert 1 - (1 - (1 - 0.85**5) ** near_dedup.band_count(0.85)) <= 1e-6


def test_parity_sketches_lose_no_link(spark):
    """Sketches differ in no more places than the sets do, and keep apart what a join by bands cannot."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > share], rng.integers(0, 1 << 62, 20).astype(np.uint64)])) for share in (0, 0.02, 0.1, 0.5, 1)] + [np.zeros(0, np.uint64)]
    sketches = near_dedup.parities(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert not sketches[-1].any()
    pairs = spark.createDataFrame([(x, y, sketches[x].tolist(), sketches[y].tolist()) for x in range(6) for y in range(6)], "x int, y int, a array<long>, b array<long>")
    for r in pairs.select("x", "y", near_dedup.least_difference(pairs["a"], pairs["b"]).alias("least")).collect():
        truth = len(np.setxor1d(sets[r.x], sets[r.y]))
        assert truth * 0.8 <= r.least <= truth and (truth - r.least) % 2 == 0


def test_near_dedup_in_a_group_just_under_the_threshold(spark):
    """Copies of one text with own edits, most of which are no links: every true link is found, and no other."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(240)]
    rows = []
    for k in range(80):
        copy = list(words)
        for at in rng.choice(240, 4 + k % 4, replace=False):
            copy[at] = f"e{rng.integers(0, 40)}"
        rows.append((k, " ".join(copy)))
    got = near_dedup.NearDedup(3, 85).run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(rows, 3, 85)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (None, 1)] + [(100, 100 + k) for k in range(1, 40)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got[5] == got[4] == got[3] == 3 and got[9] == got[8] == 8 and got[139] == 100 and 7 not in got
    assert components(links.limit(0)).count() == 0


def test_decontamination_equals_exact_containment(spark, docs, small):
    items = spark.createDataFrame([(1, PASSAGE, "t"), (2, "two words", "t"), (3, None, "t"), (4, "", "t"), (5, PASSAGE + " with a tail", "t"), (5, "no such thing at all in here", "t")], "item_id long, text string, doc_id string")
    cases = [(docs, ROWS, items), (small, [(r.doc_id, r.text) for r in small.collect()], spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet"))]
    for table, rows, bench in cases:
        got = decontaminate.contaminated(table, bench).collect()
        want = []
        for i, t in rows:
            for r in bench.collect():
                q, w = shingles(r.text, 5), min(5, max(1, len(WORD.findall(r.text or ""))))
                if q and len(q & shingles(t, w)) >= 0.8 * len(q):
                    want.append((i, r.item_id, len(q & shingles(t, w))))
        assert sorted(((r.doc_id, r.item_id, r.n_shared) for r in got), key=str) == sorted(want, key=str)
    assert decontaminate.contaminated(docs, items.limit(0)).count() == decontaminate.contaminated(docs.limit(0), items).count() == 0
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted((x for x in ROWS if not (x[0] in (3, 4, 11) or x[1] == PASSAGE)), key=str)
    rows = spark.createDataFrame([("a", f"x {PASSAGE}"), ("a", "a clean row of the same id"), ("b", PASSAGE)], "doc_id string, text string")
    assert [(r.doc_id, r.text) for r in decontaminate.decontaminated(rows, items).collect()] == [("a", "a clean row of the same id")]


def test_decontamination_against_very_many_items(spark):
    """A large item table is joined; the filters are full enough to let wrong hashes through."""
    word = lambda k, j: f"w{(k * 2654435761 + j * j * 40503 + j) % 1000003}"
    item = lambda k: " ".join(word(k, j) for j in range(12 + k % 30))
    n = 100_000
    items = spark.createDataFrame([(k, item(k)) for k in range(n)], "item_id long, text string")
    whole = {k: f"some words before {item(k)} and some after" for k in range(0, n, 997)}
    part = {n + k: " ".join(item(k).split()[: (12 + k % 30) // 2]) + " and quite other words" for k in range(0, n, 997)}
    docs = spark.createDataFrame(list((whole | part).items()), "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in whole} and all(r.containment == 1 for r in got)


def test_short_items_inside_long_documents(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "forty two"), (3, "a b c d"), (4, "a b c d e"), (5, "c d")], "item_id long, text string")
    rows = [(1, f"the capital is paris {LONG}"), (2, "forty two"), (3, f"{LONG} a b c d"), (4, f"x a b c d e {LONG}"), (5, "two forty parisian a b c"), (6, None), (7, "PARIS"), (8, f"{LONG} forty  TWO {LONG}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (7, 1), (2, 2), (8, 2), (3, 3), (3, 5), (4, 3), (4, 4), (4, 5)}
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, items).collect()) == [5, 6]
    duck = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        duck.register(name, df.toArrow())
    assert set(duck.execute(f"SELECT doc_id, item_id FROM ({ORACLE_SQL['op5_decontamination']})").fetchall()) == got


def test_items_with_one_template_stay_linear(spark):
    """2,000 items and 4,000 documents share 26 shingles of 38: a product would be 8,000,000 candidates."""
    template = " ".join(f"t{j}" for j in range(30))
    items = spark.createDataFrame([(k, template + "".join(f" own{k}x{j}" for j in range(12))) for k in range(2000)], "item_id long, text string")
    rows = [(k, f"start {template} and then {k}") for k in range(4000)] + [(4000 + k, f"x {template}" + "".join(f" own{k}x{j}" for j in range(8))) for k in range(0, 2000, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = docs.withColumn("rest", F.lit(None).cast("string"))
    found, dirty = decontaminate.searched(plain, items, 5, 0.8, False)
    index = decontaminate.item_signatures(items, 5, 0.8)
    assert decontaminate.candidates(found, index).count() <= 4040
    assert {(r.doc_id - 4000, r.item_id) for r in dirty.join(found, "row").select("doc_id", "item_id").collect()} == {(k, k) for k in range(0, 2000, 50)}


def thue_morse(a, b, n=1024):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


def test_words_are_told_apart(spark):
    """Words that every polynomial hash modulo a power of two confuses."""
    one, two = thue_morse("a", "b"), thue_morse("b", "a")
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper()), (4, f"{one} {two} c d e"), (5, f"{two} {one} c d e")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.NearDedup(3, 85).run(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    items = spark.createDataFrame([(1, f"{one} {two} c d e")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, items).collect()] == [4]
    base = {r.doc_id: r.base_score for r in lm.scored(docs.unionAll(docs.filter("doc_id = 1").select(F.lit(7).cast("long"), "text"))).collect()}
    assert base[1] == base[3] > base[2]


def test_lm_scores(spark, docs):
    rows = [(i, t or "") for i, t in ROWS]
    counts = collections.Counter()
    for i, t in rows:
        if not lm.in_fold(i):
            counts.update([*WORD.findall(lower(t)), "\0end"])
    total, kinds = sum(counts.values()), len(counts)
    got = lm.scored(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*WORD.findall(lower(t)), "\0end"])) for i, t in rows)
    for (i, base), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.base_score)), strict=True):
        assert str(r.doc_id) == i and math.isclose(base, r.base_score, rel_tol=1e-9) and r.score < 0
        assert r.train_tokens == total and r.held_out == (r.doc_id is not None and zlib.crc32(i.encode()) % 10 == 0)
    assert lm.scored(docs.limit(0)).count() == 0


@pytest.mark.parametrize("batch_bytes", [8 << 20, 2000])
def test_lm_knows_rare_bytes_in_context(spark, batch_bytes):
    hot = [(k, " ".join(chr(33 + (k * 7 + j * j) % 90) * 3 for j in range(300))) for k in range(40)]
    rare = [(100 + k, "щука, плыла; по реке и ещё дальше" * 3) for k in range(8)] + [(200, None), (None, "щука")]
    rows = hot + rare
    training, values = [(t or "").encode() for i, t in rows if not lm.in_fold(i)], [(t or "").encode() for _, t in rows]
    assert len(set(b"".join(values))) > 62 and 0 < len(training) < len(rows)
    alphabet = lm.Alphabet(lm.histogram(training))
    s, c, _ = alphabet.coded(training)
    index, count = np.unique(c.astype(np.int64) * lm.SYMBOLS + s, return_counts=True)
    want = lm.Trie(index % lm.SYMBOLS**lm.ORDER, count, index, count).scores(alphabet, values)
    got = {r.doc_id: r.score for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=batch_bytes).collect()}
    assert len(got) == len(rows) and all(math.isclose(got[i], w, rel_tol=1e-5) for (i, _), w in zip(rows, want, strict=True))
    assert all(got[i] / len(t.encode()) > -0.2 for i, t in rare[:8])  # a script that few documents have is learnt like others


def test_trie_probabilities_sum_to_one_and_match_exclusion():
    values = [b"abracadabra", b"abrabra", b"", b"xyz \xff"]
    alphabet = lm.Alphabet(lm.histogram(values))
    s, c, _ = alphabet.coded(values)
    index, count = np.unique(c.astype(np.int64) * lm.SYMBOLS + s, return_counts=True)
    short = np.unique(index % lm.SYMBOLS**lm.ORDER, return_inverse=True)
    trie = lm.Trie(short[0], np.bincount(short[1], weights=count), index, count)
    assert np.allclose((10.0 ** trie.log10.astype(float)).sum(1), 1, atol=1e-5)
    # by hand: escape through all orders with exclusion, for one position
    seen = [collections.defaultdict(collections.Counter) for _ in range(lm.ORDER + 1)]
    for v in values:
        t = [0] * lm.ORDER + [int(alphabet.symbol[x]) for x in v] + [0]
        for k in range(lm.ORDER, len(t)):
            for o in range(lm.ORDER + 1):
                seen[o][tuple(t[k - o : k])][t[k]] += 1

    def chance(context, symbol, out=frozenset()):
        if context is None:
            return 1 / (lm.SYMBOLS - len(out))
        n = {x: m for x, m in seen[len(context)][context].items() if x not in out}
        given, total = 0.5 if len(n) + len(out) < lm.SYMBOLS else 0.0, sum(n.values())
        if symbol in n:
            return (n[symbol] - given) / total
        return (len(n) * given / total if n else 1.0) * chance(context[1:] if context else None, symbol, out | set(n))

    text = b"abrx"
    t = [0] * lm.ORDER + [int(alphabet.symbol[x]) for x in text] + [0]
    want = sum(math.log10(chance(tuple(t[k - lm.ORDER : k]), t[k])) for k in range(lm.ORDER, len(t)))
    assert math.isclose(trie.scores(alphabet, [text])[0], want + sum(alphabet.spelling[x] for x in text), rel_tol=1e-4)


def test_adaptive_code_length(spark):
    """Against counts gathered anew for every symbol."""
    for text in (b"", b"a", b"abracadabra abracadabra", bytes(range(256)) + b"\xff\x00\xff\x00", b"mississippi" * 5):
        t, want = [0] * lm.ORDER + [x + 1 for x in text] + [0], 0.0
        for at in range(lm.ORDER, len(t)):
            gone = set()
            for k in range(lm.ORDER, -1, -1):
                seen = collections.Counter(t[j] for j in range(lm.ORDER, at) if t[j - k : j] == t[at - k : at])
                left = {x: n for x, n in seen.items() if x not in gone}
                given = 0.5 if len(seen) < lm.SYMBOLS else 0.0
                if t[at] in left:
                    want -= math.log2((left[t[at]] - given) / sum(left.values()))
                    break
                if left:
                    want -= math.log2(len(left) * given / sum(left.values()))
                gone |= set(seen)
            else:
                want += math.log2(lm.SYMBOLS - len(gone))
        assert math.isclose(lm.adaptive_bits(text), want, rel_tol=1e-9)
    docs = spark.createDataFrame([(1, "ab" * 2000), (2, None), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.adaptive(docs).collect()}
    assert got[1].bits < 200 and got[1].n_bytes == 4000 and math.isclose(got[2].bits, lm.adaptive_bits(b""))


def test_quality_holds_out(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    train, rest = labels.filter("doc_id % 4 > 0"), labels.filter("doc_id % 4 = 0")
    got = quality.graded(docs, quality.trained(docs, train)).join(rest, "doc_id").collect()
    share = lambda rows, want: sum(r.kept == want for r in rows) / len(rows)
    assert share([r for r in got if r.quality == 1 and r.toxic == 0], True) > 0.97
    assert share([r for r in got if r.toxic == 1], False) > 0.8
    assert share([r for r in got if r.quality == 0], False) > 0.8


def test_quality_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = quality.graded(docs, quality.trained(docs, some)).collect()
        assert len(got) == len(ROWS) and all(0 <= r.tail_probability <= 1 for r in got)
    assert all(r.kept for r in got)
    index, counts = quality.features([b"good fine text"] * 30 + [b"so so text"] * 30 + [b"bad awful text"] * 30)
    used, slots = np.unique(index, return_inverse=True)
    model = quality.fit(slots, counts, np.repeat([2, 1, 0], 30), used)
    tails = model.tails([b"good fine text", b"so so text", b"bad awful text"])
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert list(tails.sum(1).round()) == [2, 1, 0]


def test_repeated_labelled_ids_are_bounded(spark, monkeypatch):
    """Copies of a labelled row count once, and rows of one id are sampled like others."""
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda slots, counts, grades, used: seen.append(len(grades)) or fit(slots, counts, grades, used))
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("good text "), F.translate((F.col("id") % 500).cast("string"), "0123456789", "abcdefghij")).alias("text"))
    others = spark.range(2, 42).select(F.col("id").alias("doc_id"), F.concat(F.lit("bad text "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    labels = spark.range(1, 42).select(F.col("id").alias("doc_id"), (F.col("id") == 1).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    held = [(r.doc_id, tuple(quality.features([r.text.encode()])[0])) for r in docs.unionAll(others).collect()]
    assert 530 < len(set(held)) <= 540  # by chance two words may have one feature
    for sample, want in ((1000, len(set(held))), (50, 100)):
        quality.trained(docs.unionAll(others), labels, sample)
        assert seen.pop() == want
    one, twice = (quality.trained(x, labels) for x in (others, others.unionAll(others)))
    assert (one.weights == twice.weights).all() and (one.thresholds == twice.thresholds).all()


def test_ordinal_likelihood_and_slopes():
    """The likelihood against its definition, and its slopes against differences."""
    r = np.random.default_rng(5)
    rows = [r.choice(9, r.integers(1, 6), replace=False) for _ in range(60)]
    grades = r.integers(0, quality.GRADES, 60)
    likelihood = quality.Likelihood(np.concatenate(rows), np.array([len(x) for x in rows]), grades, 9, 0.01)
    w, first, gaps = r.normal(size=9), -0.4, np.array([0.3])

    def by_hand(w, first, gaps):
        cuts = [first, first + math.exp(gaps[0])]
        at_least = lambda s, k: 1.0 if k == 0 else 0.0 if k == 3 else 1 / (1 + math.exp(cuts[k - 1] - s))
        logs = [math.log(at_least(w[x].sum(), g) - at_least(w[x].sum(), g + 1)) for x, g in zip(rows, grades, strict=True)]
        return sum(logs) / 60 - 0.005 * (w * w).sum()

    value, up, first_up, gap_up = likelihood.slopes(w, first, gaps)
    assert math.isclose(value, by_hand(w, first, gaps), rel_tol=1e-9)
    e = 1e-6
    for k in range(9):
        d = np.eye(9)[k] * e
        assert math.isclose(up[k], (by_hand(w + d, first, gaps) - by_hand(w - d, first, gaps)) / (2 * e), rel_tol=1e-4, abs_tol=1e-8)
    assert math.isclose(first_up, (by_hand(w, first + e, gaps) - by_hand(w, first - e, gaps)) / (2 * e), rel_tol=1e-4)
    assert math.isclose(gap_up[0], (by_hand(w, first, gaps + e) - by_hand(w, first, gaps - e)) / (2 * e), rel_tol=1e-4)


def test_features_are_chosen_as_counted_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = quality.trained(docs, labels)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rated = sorted((r.doc_id, r.quality + 1 - r.toxic) for r in labels.collect() if r.doc_id in text)
    index, counts = quality.features([text[i] for i, _ in rated])
    grades = np.array([g for _, g in rated])
    size = len(model.weights)
    held, total = np.bincount(index, minlength=size), np.bincount(index, weights=np.repeat(grades, counts), minlength=size)
    used = np.flatnonzero(quality.signals(held, total, len(grades), grades.sum(), (grades**2).sum()))
    slot = np.full(size, -1)
    slot[used] = np.arange(len(used))
    mine = slot[index]
    want = quality.fit(mine[mine >= 0], np.bincount(np.repeat(np.arange(len(grades)), counts)[mine >= 0], minlength=len(grades)), grades, used)
    assert len(used) and np.allclose(model.weights, want.weights) and np.allclose(model.thresholds, want.thresholds)


def segmentations(word, vocab):
    def rest(i):
        if i == len(word):
            yield (), 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in vocab.pieces:
                k, s = vocab.pieces[word[i:j]]
                yield from (((k, *p), s + q) for p, q in rest(j))
            elif j == i + 1:
                b = vocab.fallback(word[i])
                yield from (((*(vocab.byte_ids[x] for x in b), *p), len(b) * vocab.byte_score + q) for p, q in rest(j))

    return list(rest(0))


def test_token_counts_equal_brute_force(docs):
    vocab = vocabulary(DEFAULT_MODEL)
    words = ["hello", "help", " helpless", "é☃b", "\n", " ", "x", "thanea", "thanes"]
    found = token_counts.terminal_counts(set(words), vocab, vocab.tree)
    for w in words:
        every = segmentations(w, vocab)
        best = max(s for _, s in every)
        assert found[w] == min(len(p) for p, s in every if s >= best - 1e-9)
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs).collect()}
    alone = {w: token_counts.terminal_counts({w}, vocab, vocab.tree)[w] for t in (LONG, ROWS[9][1]) for w in set(pretokens(t))}
    assert got[8] == sum(alone[w] for w in pretokens(LONG)) and got[10] == sum(alone[w] for w in pretokens(ROWS[9][1])) and got[5] == got[6] == 0
    assert token_counts.counted(docs.limit(0)).count() == 0


def test_sampling_without_replacement_has_the_exact_law():
    vocab, table = vocabulary(DEFAULT_MODEL), segmentation._transitions(DEFAULT_MODEL)
    cut, n, k = pretokens("the éa"), 3000, 4
    every = [((), 0.0)]
    for w in cut:
        every = [(a + b, s + q) for a, s in every for b, q in segmentations(w, vocab)]
    norm = math.log(sum(math.exp(s) for _, s in every))
    p = {a: math.exp(s - norm) for a, s in every}
    s = segmentation.Sampler(np.array([segmentation.row_key(i) for i in range(n)], np.uint64), [cut] * n, vocab, table)
    got, weight = collections.defaultdict(list), 0.0
    for o in s.samples(k):
        flat, ends = s.ids(o["edge"], o["begin"], o["stop"])
        for d, a, b, lp, value in zip(o["docs"], np.r_[0, ends[:-1]], ends, o["log_prob"], o["perturbed"], strict=True):
            path = tuple(flat[a:b].tolist())
            assert math.isclose(p[path], math.exp(lp), rel_tol=1e-6)
            got[d].append((path, value))
            weight += p[path] / -math.expm1(-math.exp(lp - s.next_value[d]))
    assert all(len({x for x, _ in v}) == k and [x for _, x in v] == sorted((x for _, x in v), reverse=True) for v in got.values())
    second = collections.Counter(v[1][0] for v in got.values())
    for path in sorted(p, key=lambda x: -p[x])[:3]:
        want = sum(p[q] * p[path] / (1 - p[q]) for q in p if q != path)
        assert abs(second[path] / n - want) < 4 * math.sqrt(want / n) + 2e-3
    assert abs(weight / n - 1) < 0.05  # inclusion scores give an unbiased total


def test_lattices_are_built_once_and_change_no_sample(monkeypatch):
    vocab, table = vocabulary(DEFAULT_MODEL), segmentation._transitions(DEFAULT_MODEL)
    cut = [pretokens(t) for t in (LONG, "the helpless thane", "", "é☃b\n\n x", "the of and helpful " * 300, "\n" * 100)]
    keys = np.array([segmentation.row_key(i) for i in range(len(cut))], np.uint64)

    def drawn(rows, lattices):
        s, got = segmentation.Sampler(keys[rows], [cut[r] for r in rows], vocab, table, lattices), {}
        for j, o in enumerate(s.samples(3)):
            flat, ends = s.ids(o["edge"], o["begin"], o["stop"])
            for d, a, b, lp, value in zip(o["docs"], np.r_[0, ends[:-1]], ends, o["log_prob"], o["perturbed"], strict=True):
                got[rows[d], j] = (flat[a:b].tolist(), lp, value, s.next_value[d])
        return got

    want = drawn(list(range(len(cut))), None)
    lattices = segmentation.Lattices(vocab, table)
    alone = [drawn([r], lattices) for r in range(len(cut))]
    assert {k: v for part in alone for k, v in part.items()} == want  # to the last bit, whatever is drawn or was built with a row
    built = lattices.nodes, lattices.edges, lattices.letters
    assert built[2] == sum(map(len, {w for words in cut for w in words}))
    assert drawn([4, 1, 0], lattices) == {k: v for k, v in want.items() if k[0] in (0, 1, 4)}
    assert (lattices.nodes, lattices.edges, lattices.letters) == built  # words met before are not built again
    for bound in (10, 1 << 20, 10):
        lattices.bounded(bound)
        assert not lattices.letters and drawn([4, 0], lattices) == {k: v for k, v in want.items() if k[0] in (0, 4)}
    monkeypatch.setattr(segmentation, "REACH", 1e9)  # draws for all regions
    assert drawn(list(range(len(cut))), None) == want


def test_segmentations_decode_to_the_text(docs):
    got = segmentation.decoded(segmentation.encoded(docs)).collect()
    text = collections.defaultdict(set)
    for i, t in ROWS:
        text[i].add(t or "")
    assert all(r.text in text[r.doc_id] for r in got)
    assert {r.doc_id for r in got if r["sample"] == 0} == set(text)
    again = segmentation.encoded(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r["sample"], tuple(r.pieces))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert segmentation.encoded(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["", "\\", "### User: x", "a</turn>\n### Assistant: b", "<|image_0|>", "\\<|image_0|>", chat.PROBE, "\n", "é "]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)] + [(2, 0, None, None), (None, 3, "assistant", "x"), (2, None, "a:b\\", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(4)
    out = chat.format_conversations(chat.text_parts(turns))
    held = {r.conv_id: r for r in out.collect()}
    assert [(a, b) for a, b, _, _ in chat.parse_turns(held[1].formatted)] == [(("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)]
    assert [(a, b) for a, b, _, _ in chat.parse_turns(held[2].formatted)] == [("a:b\\", "y"), ("none", "")]
    d = {r.conv_id: r for r in chat.conversation_digests(out).collect()}
    loss = "".join(nasty[1::2])
    assert (d[1].loss_chars, d[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[: len(nasty)]).encode()).hexdigest()
    assert chat.format_conversations(chat.text_parts(turns.limit(0))).count() == 0


def test_turns_are_streamed(spark):
    """One conversation holds nearly all rows; turns read back as a stream and from joined strings agree."""
    big = spark.range(60000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 > 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("### t </turn> \\ "), F.col("id")).alias("text"))
    few = spark.createDataFrame([(k, t, ("user", "assistant")[t % 2], None if t == 2 else f"{k}<|é{t}") for k in range(4) for t in range(k + 1)] + [(None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    turns = chat.text_parts(big.unionAll(few).repartition(7))
    formatted = chat.format_turns(turns)
    got = {tuple(r) for r in chat.turn_digests(formatted).collect()}
    assert got == {tuple(r) for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    assert len(got) == 6 and {r[0]: r[1] for r in got}[5] == 60000
    texts = [f"### t </turn> \\ {k}" for k in range(60000)]
    loss = "".join(t for k, t in enumerate(texts) if k % 3)
    row = next(r for r in got if r[0] == 5)
    assert row[2] == hashlib.sha256("".join(f"{'assistant' if k % 3 else 'user'}\n{t}\n" for k, t in enumerate(texts)).encode()).hexdigest()
    assert row[3:5] == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    mixed = formatted.repartition(5, "place")
    assert {tuple(r) for r in chat.turn_digests(mixed, dealt=False).collect()} == got
    with pytest.raises(Exception, match="does not follow"):
        chat.turn_digests(formatted.filter("place <> 1")).collect()


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|image_0|>"}, {"type": "image", "ref": "s3/cat.png", "size": 600 * 600}, {"type": "audio", "ref": "a.wav", "size": 6400}, {"type": "document", "ref": "d", "size": 10}]
    df = spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,size:bigint>>")
    r = chat.format_conversations(df).first()
    assert chat.placeholders(r.formatted) == [("image", 0), ("audio", 1), ("document", 2)]
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "s3/cat.png", 425), ("audio", "a.wav", 10), ("document", "d", 3)]
    assert r.expanded_tokens == 438


def test_png_rows_of_all_filters_and_colours():
    r = np.random.default_rng(8)
    for bpp in (1, 3):
        samples = r.integers(0, 256, (40, 20 * bpp), dtype=np.uint8)
        mixed = np.stack([media.filtered(samples, k, bpp) for k in range(5)])[r.integers(0, 5, 40), np.arange(40)]
        assert set(mixed[:, 0]) == set(range(5)) and (media.unfiltered(mixed, bpp) == samples).all()
        header = media.struct.pack(">IIBBBBB", 20, 40, 8, 2 if bpp == 3 else 0, 0, 0, 0)
        png = media.SIGNATURE + media.chunk(b"IHDR", header) + media.chunk(b"IDAT", zlib.compress(mixed.tobytes())) + media.chunk(b"IEND", b"")
        assert (media.read_png(png).reshape(40, -1) == samples).all()


@pytest.mark.parametrize("kind", [None, *range(5)])
@pytest.mark.parametrize("rows", [1, 7])
def test_png_filters_round_trip(kind, rows):
    data = np.random.default_rng(kind or 0).integers(0, 256, rows * 192, dtype=np.uint8).tobytes()
    png = media.write_png(data, kind=kind)
    assert media.read_png(png).tobytes() == data
    for at in (0, 20, len(png) // 2, len(png) - 1):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bytes(bad))


def test_media_columns(spark, docs):
    made = media.with_media(docs)
    got = {r.doc_id: r for r in media.media_features(made).collect()}
    for i, t in ROWS[:10]:
        data = (t or "").encode()
        data += b" " * (-len(data) % 192 if data else 192)
        assert (got[i].payload_sha256, got[i].payload_bytes, got[i].tail_crc32) == (hashlib.sha256(data).hexdigest(), len(data), zlib.crc32(data[-16:]))
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256
    texts = [zlib.decompress(b"".join(body for kind, body in media.chunks(r.media) if kind == b"IDAT")) for r in made.filter("doc_id = 8").collect()]
    assert {x for t in texts for x in t[::193]} - {media.NONE}  # filters are chosen, so reading back undoes them
    broken = media.media_features(made.withColumn("media", F.lit(b"\x89PNG broken"))).collect()
    assert all(r.feature is None and r.error for r in broken)
    assert media.media_features(media.with_media(docs.limit(0))).count() == 0


def test_html_blocks():
    page = "<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>one\n two<p>three<script>x('<p>')</script><ul><li>a<li>b</ul><!-- no --></article><aside>side</aside>&copy;"
    assert [b.text for b in html.blocks(page)] == ["Home", "T & U", "one two", "three", "a", "b", "side", "©"]
    assert [html.teacher(b) for b in html.blocks(page)] == [0, 1, 1, 1, 1, 1, 0, None]
    for broken in ("", "<", "<p", "</p>", "<script>never ends", "<!-- never ends", "a<b>c", "<p>" * 3000, "&#0;&#xD800;&bogus;"):
        html.blocks(broken)


def test_html_gradients():
    cut = html.blocks("<main><p>aa bb<p>cc</main><footer>dd <a>ee</a></footer>")
    model = html.Labeller()
    data = model.padded([html.vectors(cut), html.vectors(cut[:1])])
    target, weight = np.array([1.0, 1, 0, 1]), np.ones(4)
    _, g = model.gradients(data, target, weight)
    for name, slope in g.items():
        flat, j = model.p[name].reshape(-1), int(np.argmax(abs(slope.reshape(-1))))
        old, e = flat[j], 1e-5
        flat[j] = old + e
        up = model.gradients(data, target, weight)[0]
        flat[j] = old - e
        down = model.gradients(data, target, weight)[0]
        flat[j] = old
        assert math.isclose((up - down) / (2 * e), slope.reshape(-1)[j], rel_tol=1e-4)


def test_html_extraction(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    model = html.trained(pages)
    got = {r.page_id: r.text for r in html.extracted(pages, model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = "\n".join(x for x in (" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in re.split(r"<(?:p|br|h1|/h1|/p)>", inside)) if x)
        assert got[r.page_id] == __import__("html").unescape(want)
    body = "<p>" + "</p><p>".join("A sentence of the main text that goes on for a while, and more." for _ in range(5)) + "</p>"
    odd = [
        (1, None, None), (2, "u", ""), (3, "u", f"<body><header>Site</header><main>{body}</main><div class='comments'><p>nice one</p></div><footer>f</footer>"),
        (4, "u", f"<div id=cookie-notice>We use cookies</div><article>{body}<form>Your mail</form></article><aside class=sidebar>links</aside>"),
    ]
    out = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(odd, "page_id long, url string, html string"), model).collect()}
    clean = "\n".join(["A sentence of the main text that goes on for a while, and more."] * 5)
    assert out == {1: "", 2: "", 3: clean, 4: clean}
    assert html.extracted(pages.limit(0), html.trained(pages.limit(0))).count() == 0


def test_html_deep_wrappers(spark):
    block = lambda path: html.Block(tuple(path.split(">")), "same text", 0)
    one, two = html.vectors([block(f"body>{wrap}>div>div>ul>li>div>p>a") for wrap in ("aside", "article")])[0]
    assert one != two
    assert html.vectors([block("div a b c d e f g h i comments")])[0] != html.vectors([block("div a b c d e f g h i")])[0]
    assert "comments" in html.blocks("<div class='a b c d e f g h i comments'>x")[0].path[0]
    model = html.trained(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet"))
    body = "".join(f"<p>Sentence {k} of the main text that goes on for a while, and more.</p>" for k in range(5))
    deep = lambda wrap, inside: f"<{wrap}><div><div><ul><li><div><section><div>{inside}</div></section></div></li></ul></div></div></{wrap.split()[0]}>"
    page = f"<html><body>{deep('nav', '<p><a href=x>Home page</a></p>')}{deep('article', body)}{deep('aside', '<p><a href=y>Some other story that is told elsewhere</a></p>')}{deep('div class=comments', '<p>What a nice story, thank you.</p>')}</body></html>"
    assert model.main_text([html.blocks(page)])[0].split("\n") == [f"Sentence {k} of the main text that goes on for a while, and more." for k in range(5)]


def test_html_reads_markup_like_html():
    cases = {
        "<p title=it's>hello world</p>": ["hello world"],
        "<a href=x'y>t</a>": ["t"],
        '<a href = "a>b" title=\'c>d\'>t</a> u': ["t u"],
        "<article><p>a</p><!--><p>b</p><!---><p>c</p></article>": ["a", "b", "c"],
        "<p>a<!-- x --!>b<!-- never <p>ends": ["ab"],
        "<p>a</><?php x ?><![CDATA[ y ]]>b": ["ab"],
        "<p>a < b and 3<4</p>": ["a < b and 3<4"],
        '<p class="x>lost quote</p><p>next</p>': ["lost quote", "next"],
        "<b>x<div>y</b>z</div>": ["x", "yz"],
        "<ul><li>a<ul><li>b</ul><li>c</ul>": ["a", "b", "c"],
        "<table><tr><td>a<td>b<tr><td>c</table>": ["a", "b", "c"],
    }
    for page, want in cases.items():
        assert [b.text for b in html.blocks(page)] == want, page
    assert html.blocks("<div class=a id='b c' role=\"d\">x")[0].path == ("div a b c d",)


@pytest.mark.parametrize("page", ["<div>" * 60000 + "</span>" * 60000 + "x", "<span>" + "<div>" * 60000 + "</span>" * 60000 + "x", "<![CDATA[" * 60000, "<!x" * 60000, "<b>" * 60000 + "<hr>x" * 60000, "<p class='" * 60000, "".join(f"<div class=c{k}>x" for k in range(20000)), "</" * 60000, "<a b=" * 60000])
def test_html_time_is_linear(page):
    began = time.process_time()
    html.vectors(html.blocks(page))
    assert time.process_time() - began < 20


def test_html_pages_without_telling_names(spark):
    """Plain division and table layouts, read by a labeller that has seen named pages, and by one that has not."""
    sentence = lambda k: f"The committee of the town met on day {k} of the month, and it decided to build a bridge over the river."
    links = "".join(f"<a href=/{k}>Page {k}</a> " for k in range(6))
    body = [sentence(k) for k in range(6)]
    div = f"<html><body><div><div>{links}</div></div><div><div>" + "".join(f"<p>{x}</p>" for x in body) + f"</div></div><div>{links}</div></body></html>"
    td = f"<html><body><table><tr><td>{links}</td></tr><tr><td>" + "".join(f"<p>{x}</p>" for x in body) + f"</td></tr><tr><td>{links}</td></tr></table></body></html>"
    named = html.trained(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet"))
    plain = html.trained(spark.createDataFrame([(p.replace("river", f"river{k}"),) for p in (div, td) for k in range(20)], "html string"))
    for model in (named, plain):
        assert [t.split("\n") for t in model.main_text([html.blocks(div), html.blocks(td)])] == [body, body]
    bare = html.trained(spark.createDataFrame([("<p>a<p>b",)], "html string"))
    assert bare.main_text([html.blocks("<p>a<p>b")]) == ["a\nb"]


def test_html_trains_on_distinct_whole_pages(spark, monkeypatch):
    long = "<article>" + "<p>some words</p>" * 450 + "<p>" + "word " * 45000 + "</p></article><footer>end</footer>"
    short = [f"<article><p>text {k}</p></article><footer>end</footer>" for k in range(3)]
    seen, varied = [], html.varied
    monkeypatch.setattr(html, "varied", lambda page, r: seen.append(len(page)) or varied(page, r))
    monkeypatch.setattr(html.Labeller, "fit", lambda self, pages, targets: 0.0)
    pages = spark.createDataFrame([(p,) for p in [short[0]] * 20 + short[1:] + [long]], "html string")
    html.trained(pages, sample=4)
    assert sorted(seen) == [2] * 15 + [452] * 5


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
