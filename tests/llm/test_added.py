"""Operators 11 to 13 against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import chat, decontaminate, lm, merkle, near_dedup, periodic_runs, queries, secrets

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, row int, kind string, h long"
ROWS = [
    (3, "b", "en", 4, "a\nb"),
    (1, "b", None, None, None),
    (2, "b", "", 0, ""),
    (2, "b", "", 0, ""),
    (5, None, "de", 3, "é\n\n😀"),
    (None, "b", "en", 1, "x\n"),
    (None, None, None, None, None),
    (9, "é", "en", 1, "one two one two one two one two one two"),
    (8, "Z", "en", 1, "w " * 3000),
    (7, "", "en", 1, "a b c"),
]
digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", 7) for r in ROWS], SCHEMA).repartition(3)


def folded(nodes):
    """The root over a list of digests, and the digests beside each one's path with those left of it counted."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for leaf, i in enumerate(at):
            run = runs[i // 3]
            paths[leaf].append((run[: i % 3], run[i % 3 + 1 :]))
        at, nodes = [i // 3 for i in at], [digest(r) for r in runs]
    return nodes[0], paths


def manifest(rows):
    def leaf(r, text):
        return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text))

    groups = {}
    for r in rows:
        changed = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[4]), leaf(r, r[4].replace("\n", "")) if changed else leaf(r, r[4]), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [folded([x[1] for x in sorted(groups[g])]) for g in names]
    root, upper = folded([t[0] for t in trees])
    out = []
    for g, (subroot, paths), beyond in zip(names, trees, upper, strict=True):
        for (_, mine, offered, doc), path in zip(sorted(groups[g]), paths, strict=True):
            h = offered
            for left, right in [*path, *beyond]:
                h = digest([*left, h, *right])
            out.append((doc, mine, subroot, root, digest(n for a, b in [*path, *beyond] for n in a + b), h, h == root))
    return sorted(out, key=str)


def altered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_brute_force(spark, docs, levels):
    got = merkle.proved(docs, levels=levels, proofs=False, tampered=altered()).collect()
    assert sorted(map(tuple, got), key=str) == manifest(ROWS)
    assert merkle.proved(docs.limit(0), tampered=altered()).count() == 0


def test_manifest_of_documents_with_small_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    got = merkle.proved(hot, levels=2, tampered=altered())
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in hot.collect()]
    assert sorted(map(tuple, got.drop("proof").collect()), key=str) == manifest(rows)
    one = got.filter("doc_id = 3").first()
    h = one.leaf
    for left, right in one.proof:
        h = digest([left, h, right])
    assert h == one.root


def test_one_row_is_its_own_root(spark):
    one = spark.createDataFrame([(4, "s", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.proved(one, proofs=False).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == digest([])
    assert merkle.proved(one.withColumn("doc_id", F.lit("x")), proofs=False).first().doc_id == "x"


def test_missing_nodes_are_just_enough():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 80)
        known = {r.randrange(n) for _ in range(r.randint(1, 6))}
        need, at, size, level, want = set(), known, n, 0, set()
        for i in known:  # every proof on its own
            j, m, depth = i, n, 0
            while m > 1:
                need |= {(depth, k) for k in range(j // 3 * 3, min(j // 3 * 3 + 3, m)) if k != j}
                j, m, depth = j // 3, -(-m // 3), depth + 1
        while size > 1:
            want |= {(level, k) for lv, k in need if lv == level and k not in at}
            at, size, level = {k // 3 for k in at}, -(-size // 3), level + 1
        assert set(merkle.missing(known, n)) == want


def told(text):
    """Spans of the patterns and of entropy, one window after another."""
    text, out = text or "", []
    for m in re.finditer(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    w = secrets.WIDTH
    for k, c in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(f"[{c.characters}]+", text):
            hits = []
            for p in range(len(m[0]) - w + 1 if not any(re.fullmatch(a, m[0]) for a in secrets.ALLOWED) else 0):
                x = m[0][p : p + w]
                if -sum(x.count(ch) / w * math.log2(x.count(ch) / w) for ch in set(x)) >= c.bits - 1e-9:
                    if hits and p <= hits[-1][1]:
                        hits[-1][1] = p + w
                    else:
                        hits.append([p, p + w])
            out += [(m.start() + a, k, m.start() + b) for a, b in hits]
    return sorted(out)


def test_secrets_equal_brute_force(spark):
    r = random.Random(3)
    letters = "abcdef0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/_=-"
    some = lambda n, of=letters: "".join(r.choice(of) for _ in range(n))
    makers = [
        lambda: some(r.randint(10, 70), letters[:16]),
        lambda: some(r.randint(10, 90)),
        lambda: r.choice(["token", "Secret", "API_KEY", "apikey", "PassWord", "toKen"]) + r.choice(["=", ": ", "\"= '", ":=", "=="]) + r.choice(["", "token=", "x=secret: "]) + some(r.randint(0, 30), letters + "."),
        lambda: "AKIA" * r.randint(1, 3) + some(r.randint(0, 25), "ABCXYZ0189"),
        lambda: "é😀" * r.randint(1, 3),
        lambda: "a" * r.randint(1, 60) + some(40) + "0" * r.randint(0, 60) + some(40),
        lambda: "123e4567-e89b-12d3-a456-426614174000 sha512-" + some(50, letters[:60]) + " abcdefghijklmnopqrstuvwxyz0123456789",
        lambda: "\n some words here\t",
    ]
    texts = ["".join(r.choice(makers)() + r.choice([" ", "", ",", '"']) for _ in range(r.randint(0, 20))) for _ in range(400)]
    texts += [None, "", some(60_000), "token=x " * 5000, "token=token=" + some(20)]
    df = spark.createDataFrame([(k, t, "z", 1, "s") for k, t in enumerate(texts)] + [(None, "AKIA" + "A" * 20, "z", 1, "s"), (7, texts[7], "z", 1, "s")], "doc_id long, text string, kind string, row int, start string")
    got = secrets.spans(df).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        assert sorted(map(tuple, x.spans)) == told("AKIA" + "A" * 20 if x.doc_id is None else texts[x.doc_id])
    row = secrets.scan_digests(df.filter("doc_id is null")).first()
    assert tuple(row) == (None, 0, 1, 0, digest(["access:0:24"]), "access:0:24")
    assert secrets.scan_digests(df.limit(0)).count() == 0
    plan = secrets.scan_digests(df)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def runs(words, least=6, times=4):
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda t: (t[0], t[2]))


def described(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a, n = g % len(w), len(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    best = min(found, key=lambda t: (-t[1] / t[2], t[0], t[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest(f"{s},{n},{q}\n" for s, n, q in found), digest([kept]))


def test_runs_of_sequences():
    r = random.Random(5)
    for _ in range(600):
        words = []
        while len(words) < r.randint(0, 60):
            words += [r.randrange(3) for _ in range(r.randint(1, 5))] * r.randint(1, 7) if r.random() < 0.5 else [r.randrange(9) for _ in range(r.randint(1, 6))]
        for least, times in ((6, 4), (2, 2), (6, 3)):
            want, x = runs(words, least, times), np.array(words, np.int64)
            assert [tuple(t) for t in periodic_runs.runs_of(x, least, times).tolist()] == want
            a, b = periodic_runs.stretches(x, np.array([len(x)]), least, times)
            assert [(s + i, n, q) for i, j in zip(a.tolist(), b.tolist(), strict=True) for s, n, q in periodic_runs.runs_of(x[i:j], least, times).tolist()] == want


def test_periodic_runs_equal_brute_force(spark, docs):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice("abcd") * r.randint(1, 2) for _ in range(r.randint(0, 50))) + " " + "x y z q " * r.randint(0, 9)) for k in range(300)]
    rows += [(None, "t " * 12), (5, rows[5][1]), (1000, "\n".join(["a b c d e f g"] * 40)), (1001, None), (1002, " \t"), (1003, "long " * 20_000)]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id long, text string, h string, runs int").repartition(3)
    got = periodic_runs.periodic_runs(df, altered=periodic_runs.loop_number()).collect()
    assert sorted((tuple(x) for x in got if x.doc_id != 1003), key=str) == sorted((described(*x) for x in rows if x[0] != 1003), key=str)
    one = next(x for x in got if x.doc_id == 1003)
    assert one.n_runs == 1 and one.period == 1
    whole = periodic_runs.periodic_runs(docs, keep_text=True).filter("doc_id = 9").first()
    assert whole.collapsed == "one two" and tuple(whole.runs[0]) == (0, 10, 2)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    assert periodic_runs.periodic_runs(df.select(F.lit("k").alias("doc_id"), "text").limit(1)).first().doc_id == "k"


def test_runs_of_whole_documents(spark):
    got = queries.op13_periodic_runs(spark, f"{DATA}/sf0.001").collect()
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    short = {d.doc_id: d.text for d in docs if len(d.text or "") < 6000}
    assert len(got) == len(docs) and any(x.n_runs for x in got)
    for x in got:
        if x.doc_id in short:
            assert tuple(x) == described(x.doc_id, short[x.doc_id])


#: Two words that had one digest when words were mixed eight bytes at a time.
ONE, TWO = r"\/;<&johbuh/+12u", "9s;^hh;^sx~e2?wy"


def test_made_up_words_are_told_apart(spark):
    docs = spark.createDataFrame([(1, f"one two three four {ONE}"), (2, f"a b {ONE} a b {TWO}"), (3, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"one two three four {TWO}"), (8, f"one two three four {ONE}")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 8)]
    found = {r.doc_id: r for r in near_dedup.NearDedup(width=3, percent=85).run(docs).collect()}
    assert found[2].n_shingles == 4 and found[1].kept and found[2].kept
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:1] + [k for k in range(200) if zlib.crc32(str(k).encode()) % 10][:2]
    held, *learnt = ids
    texts = spark.createDataFrame([(held, f"x {TWO}"), (learnt[0], f"x {ONE}"), (learnt[1], "x y")], "doc_id long, text string")
    row = next(r for r in lm.scored(texts).collect() if r.doc_id == held)
    assert row.held_out and row.n_known == 2  # x, and the end


def test_conversations_keep_the_type_of_their_ids(spark):
    rows = [(1.5, 0, "user", "a"), (1.2, 0, "user", "b"), (1.5, 1, "assistant", "c"), (None, 0, "user", "d"), (float("nan"), 0, "user", "e"), (float("nan"), 1, "user", "f")]
    df = spark.createDataFrame(rows, "conv_id double, turn int, role string, text string")
    got = {repr(r.conv_id): r.n_turns for r in chat.conversation_digests(chat.format_conversations(chat.text_parts(df))).collect()}
    assert got == {"1.5": 2, "1.2": 1, "None": 1, "nan": 2}
    whole = chat.format_conversations(chat.text_parts(df.filter("conv_id = 1.5"))).first()
    assert whole.formatted == "### user: a</turn>\n### assistant: c</turn>\n"


def test_near_dedup_looks_members_up_once_and_not_in_each_bucket(spark):
    stars = spark.createDataFrame([(key, rep, rep % 2) for rep in range(10) for key in range(50)], "key long, rep long, center long")
    found = spark.createDataFrame([(rep, rep // 5) for rep in range(9)], "id long, component long")
    opened = near_dedup.NearDedup._open(stars, found)
    assert sorted((r.key, r.rep, r.component) for r in opened.collect()) == sorted((key, rep, rep // 5 if rep < 9 else 9) for rep in range(10) for key in range(50))
    bounds = spark.createDataFrame([(rep, 7, 7, 6, 8) for rep in range(10)], "rep long, n long, _largest long, least long, most long")
    fine = spark.createDataFrame([(rep, size, [1], [2]) for rep in range(10) for size in (7, 8)[: 1 + rep % 2]], "rep long, size long, parity array<long>, nibbles array<long>")  # odd ids have two texts
    sides = near_dedup.NearDedup._sides(opened, bounds, fine)
    assert sides.count() == sides.distinct().count() == 50 * 15
    plan = sides._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(keys") < plan.index("Join Inner")  # above it: keys are dealt out after the joins
    plan = opened._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(keys") < plan.index("Join LeftOuter")
