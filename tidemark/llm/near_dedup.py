"""Operator 6: MinHash near-duplicates with sequential Bayesian verification.

1. Each document gets its set of word shingles, a MinHash signature, band keys, and a
   128-bit cryptographic digest of its words in order. Texts with the same words form a
   class; its smallest id stands for it from then on.
2. Classes that share a band key are candidates. Each bucket is compared with its
   smallest member first (one pair a member). Signatures are compared in
   batches; a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold falls under `miss`; survivors are confirmed on the full sets, word for word.
3. Buckets whose members lie in one component are settled. Of the others, a member can only
   link with what shares enough of its set: with u shingles that no other open member
   holds, a set of n meets any other in n - u at most, which bounds the sizes of possible
   partners and settles members that have none.
4. Members that are still open get longer signatures and bands of FINE_ROWS places, and are
   compared within these much smaller buckets, again with the smallest member.
5. Where a fine bucket still lies in several components, its members are joined by the fine
   key: only pairs in different components that both bounds allow and that neither their parity
   sketches nor their long signatures rule out come from that join, and each is verified like the
   others. A parity sketch holds, for each of PARITY places, whether an odd number of shingles
   falls there; two sets differ in at least as many shingles as their sketches in places, so
   that no link is lost by it.

Band counts follow from the threshold so that a link at the threshold shares a band but
with probability `miss` (twice: bands and fine bands). The sequential test keeps a pair while the
posterior is `miss` or more, by which a link at the threshold is lost with a probability of about
1e-5 (6.5e-6 at 0.85, 9.0e-6 at 0.80). Texts with fewer words than a shingle has are one
shingle as a whole.

Confirmation deals pairs out by center and, where a center has very many, by member as well; a
center's text is sent once to each such group and not with every pair.

Ids may be of any type that sorts. Nulls: a null text, like one without words, has an empty set and links with nothing. A row
with a null id keeps its own null component and is never linked. Rows that share an id are
one node with several sets. Repeated rows give repeated results. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as ex
from tidemark.llm.common import all_word_hashes, discarded, mixed, ranked, slices, trimmed, written
from tidemark.llm.components import components

#: places of a signature that make a band: first for all classes, then for those that are left open
ROWS, FINE_ROWS = 5, 10
BATCH = 25
MISS = 1e-6
#: places of a parity sketch, a multiple of 64
PARITY = 2048
#: shingles that meet in one group when links are confirmed
GROUP = 400_000


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingles_of(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of texts, in order, and the number of each text."""
    words, sizes = all_word_hashes(values)
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    ends = np.cumsum(sizes)
    begin = np.repeat(ends - sizes, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(width, np.repeat(sizes, counts))
    total = np.zeros(len(begin), np.uint64)
    for j in range(width):
        more = slice(None) if j == 0 else np.flatnonzero(j < length)
        total[more] = mixed(total[more] ^ words[begin[more] + j], 11)
    return total, counts


def shingle_set(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words, not as hashes."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lower-cased, and the six white-space bytes separate
    return set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


@lru_cache(8)
def _factors(n: int) -> np.ndarray:
    return mixed(np.arange(n, dtype=np.uint64), 17) | np.uint64(1)


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """MinHash signatures (texts, n) of texts that have a shingle; others get zeros."""
    out = np.zeros((len(counts), n), np.uint32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    start = (np.cumsum(counts) - counts)[full]
    for k, factor in enumerate(_factors(n)):
        out[full, k] = np.minimum.reduceat((hashes * factor) >> np.uint64(32), start)
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signature.shape[1] // rows
    parts = signature.reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j], 19)
    return key.view(np.int64)


@lru_cache(64)
def fewest_matches(threshold: float, n: int, miss: float, values: int = 256) -> int:
    """Of n compared places of a signature that keeps so many values of each: the fewest matches at which the posterior of reaching the threshold is `miss` or more (uniform prior)."""
    similarity = np.linspace(0, 1, 4001)
    match = similarity + (1 - similarity) / values
    with np.errstate(divide="ignore"):
        yes, no = np.log(match), np.log1p(-match)
    no[-1] = -1e9

    def posterior(m: int) -> float:
        weight = m * yes + (n - m) * no
        weight = np.exp(weight - weight.max())
        return weight[similarity >= threshold].sum() / weight.sum()

    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if posterior(middle) >= miss else (middle + 1, high)
    return low


def nibbles(signature: np.ndarray) -> np.ndarray:
    """The low four bits of each place, sixteen to a 64-bit number."""
    low = np.zeros((len(signature), -(-signature.shape[1] // 16) * 16), np.uint64)
    low[:, : signature.shape[1]] = signature & np.uint32(15)
    return np.bitwise_or.reduce(low.reshape(len(low), -1, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=2).view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """In how many places two nibble signatures differ, as a Spark expression."""

    def places(x: Column, y: Column) -> Column:
        x = x.bitwiseXOR(y)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, places), F.lit(0), lambda total, x: total + x)


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parity sketches (texts, PARITY / 64) as 64-bit numbers, of hashes that are distinct within a text."""
    place = np.repeat(np.arange(len(counts)), counts) * PARITY + (mixed(hashes, 23) % np.uint64(PARITY)).astype(np.int64)
    place, times = np.unique(place, return_counts=True)
    place = place[times % 2 == 1]
    out = np.zeros(len(counts) * PARITY // 64, np.uint64)
    np.bitwise_or.at(out, place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    return out.reshape(len(counts), -1).view(np.int64)


def least_difference(a: Column, b: Column) -> Column:
    """In how many shingles two sets differ at least, by their parity sketches, as a Spark expression."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, PARITY // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def distinct_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of distinct hashes of each text."""
    return np.array([len(np.unique(x)) for x in np.split(hashes, np.cumsum(counts)[:-1])], np.int64)


def plausible(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two byte-signature matrices stay after all batches."""
    n = left.shape[1]
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for at in range(0, n, BATCH):
        stop = min(n, at + BATCH)
        matches[alive] += (left[alive, at:stop] == right[alive, at:stop]).sum(axis=1)
        alive = alive[matches[alive] >= fewest_matches(threshold, stop, miss)]
    keep = np.zeros(len(left), bool)
    keep[alive] = True
    return keep


class NearDedup:
    """Near-duplicates among texts whose shingle sets have a similarity of percent / 100 or more."""

    def __init__(self, width: int = 5, percent: int = 80, miss: float = MISS):
        self.width, self.percent, self.miss = width, percent, miss
        self.bands, self.fine = band_count(percent / 100, miss=miss), band_count(percent / 100, FINE_ROWS, miss)

    def sketches(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, digest, signature, keys) for each row (doc_id long, text)."""
        width, bands = self.width, self.bands

        def run(batches):
            for b in slices(batches, "text", 1 << 17):
                values = [t.encode() for t in b.column("text").to_pylist()]
                hashes, counts = shingles_of(values, width)
                signature = signatures(hashes, counts, bands * ROWS)
                n = distinct_counts(hashes, counts)
                digests = [hashlib.blake2b(b" ".join(v.lower().split()), digest_size=16).digest() for v in values]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * bands, pa.int32()), pa.array(band_keys(signature).reshape(-1)))
                low = pa.array([x.tobytes() for x in (signature & np.uint32(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), low, keys], ["doc_id", "n", "digest", "signature", "keys"])

        return docs.mapInArrow(run, "doc_id long, n long, digest binary, signature binary, keys array<long>")

    def verified(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """The links among pairs (a, b), as a written table: first by signatures, then on the full sets."""
        threshold, miss, width, percent = self.percent / 100, self.miss, self.width, self.percent
        side = lambda c, *cols: members.select(F.col("rep").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in cols))

        def likely(batches):
            for b in batches:
                if b.num_rows:
                    left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("signature_a", "signature_b"))
                    yield b.select(["a", "b", "n_b"]).filter(pa.array(plausible(left, right, threshold, miss)))

        sized = pairs.join(side("a", "n", "signature"), "a").join(side("b", "n", "signature"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        found = written(sized.select("a", "b", "n_b", "signature_a", "signature_b").mapInArrow(likely, "a long, b long, n_b long").groupBy("a", "b").agg(F.max("n_b").alias("n_b")), "likely")
        work = found.agg(F.sum("n_b")).first()[0] or 0
        slots = max(64, -(-work // GROUP))
        # a center with very many members is dealt out in several shares, each with the center's text once
        fans = found.groupBy("a").agg(F.ceil(F.sum("n_b") / GROUP).alias("shares"))
        slot = lambda share: F.pmod(F.xxhash64("a", share), F.lit(slots)).cast("int")
        right = found.select("a", "b").join(fans, "a").select(slot(F.pmod(F.xxhash64("b"), F.col("shares"))).alias("slot"), "a", "b").join(side("b", "text"), "b").select("slot", "a", "b", F.col("text_b").alias("text"))
        left = fans.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")).select(slot(F.col("share")).alias("slot"), "a").distinct().join(side("a", "text"), "a").select("slot", F.col("a").alias("center"), F.col("text_a").alias("text"))

        def confirmed(key, centers, others):
            ids, links = centers.column("center").to_pylist(), []
            order = np.argsort(others.column("a").to_numpy(), kind="stable")
            sorted_a = others.column("a").to_numpy()[order]
            for k in np.argsort(np.array(ids, np.int64), kind="stable").tolist():
                x = shingle_set(centers.column("text")[k].as_py(), width)
                at, stop = np.searchsorted(sorted_a, ids[k], "left"), np.searchsorted(sorted_a, ids[k], "right")
                for row in order[at:stop].tolist():
                    y = shingle_set(others.column("text")[row].as_py(), width)
                    shared = len(x & y)
                    if x and y and 100 * shared >= percent * (len(x) + len(y) - shared):
                        links.append((ids[k], others.column("b")[row].as_py()))
            del order, sorted_a
            trimmed()
            return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], ["a", "b"])

        links = written(left.groupBy("slot").cogroup(right.groupBy("slot")).applyInArrow(confirmed, "a long, b long"), "links")
        discarded(found)
        return links

    def shared_sizes(self, members: DataFrame) -> DataFrame:
        """(rep, shared): how many shingles of each member another member holds too."""
        width = self.width
        parts, n = ex.batched(members, "rep", "text", 1 << 19)
        digits = max(64, -(-n // ex.DIGIT_BATCHES))

        def keys(part):
            part = ex.ordered(part)
            hashes, counts = shingles_of([t.encode() for t in part.column("text").to_pylist()], width)
            sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            return part, every, np.repeat(ex.ids_of(part), [len(x) for x in sets])

        def emit(key, part):
            _, every, ids = keys(part)
            return ex.send_range(key[0].as_py(), digits, (every,), ids)

        def close(key, part, replies):
            part, every, ids = keys(part)
            order, fresh = ex.distinct((every,))
            several = np.zeros(int(fresh.sum()), bool)
            several[ex.answers(replies, 1)[0]] = True
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(fresh) - 1
            found, sums = np.unique(ids, return_inverse=True)
            shared = np.bincount(sums, weights=several[place], minlength=len(found)).astype(np.int64)
            trimmed()
            return pa.table({"rep": pa.array(found, pa.int64()), "shared": pa.array(shared, pa.int64())})

        asked = parts.groupBy("batch")
        told = ex.resolved(asked.applyInArrow(emit, ex.SENT), 1, answered=False)
        each = asked.cogroup(told.groupBy("batch")).applyInArrow(close, "rep long, shared long")
        return each.groupBy("rep").agg(F.max("shared").alias("shared"))  # of an id with several texts, what allows most

    def bounded(self, members: DataFrame) -> DataFrame:
        """(rep, n, least, most): members that can link with another one, and the sizes that its partners can have."""
        # |x & y| <= shared, and the similarity is |x & y| / (n_x + n_y - |x & y|)
        reach = F.floor(F.col("shared") * (100 + self.percent) / self.percent) - F.col("n")
        sizes = self.shared_sizes(members).join(members.groupBy("rep").agg(F.min("n").alias("n"), F.max("n").alias("_largest")), "rep")
        sure = sizes.withColumn("most", F.when(F.col("n") == F.col("_largest"), reach).otherwise(F.lit(1 << 60))).withColumn("least", F.ceil(F.col("n") * self.percent / 100))
        return sure.filter("least <= most").select("rep", "n", "_largest", "least", "most")

    def fine_keys(self, members: DataFrame) -> DataFrame:
        """(rep, size, parity, nibbles, keys) for members (rep, text): set sizes, parity sketches, long signatures of four bits a place, and keys of bands of FINE_ROWS places."""
        width, places = self.width, self.fine * FINE_ROWS

        def run(batches):
            for b in slices(batches, "text", 1 << 17):
                hashes, counts = shingles_of([t.encode() for t in b.column("text").to_pylist()], width)
                signature = signatures(hashes, counts, places)
                sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
                sizes = np.array([len(x) for x in sets], np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1))) for x in (parities(np.concatenate(sets), sizes), nibbles(signature), band_keys(signature, FINE_ROWS))]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sizes), *lists], ["rep", "size", "parity", "nibbles", "keys"])

        return members.select("rep", "text").mapInArrow(run, "rep long, size long, parity array<long>, nibbles array<long>, keys array<long>")

    @staticmethod
    def _stars(keyed: DataFrame) -> DataFrame:
        """(key, rep, center) of the buckets of (key, rep) that have several members."""
        centers = keyed.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("_last")).filter("center <> _last").select("key", "center")
        return keyed.join(centers, "key").distinct()

    @staticmethod
    def _pairs(stars: DataFrame) -> DataFrame:
        return stars.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()

    @staticmethod
    def _open(stars: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of buckets whose members lie in several components, with their component."""
        members = stars.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # a component is looked up once a member, not once a bucket
        labelled = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), F.explode("keys").alias("key"))
        several = labelled.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x <> _y").select("key")
        return labelled.join(several, "key", "left_semi")

    @staticmethod
    def _sides(opened: DataFrame, bounds: DataFrame, fine: DataFrame) -> DataFrame:
        """The rows (key, rep, component) of open buckets with what bounds and fine tell of rep, which is joined once a member and not once a bucket that it is in."""
        gathered = opened.groupBy("rep", "component").agg(F.collect_set("key").alias("keys"))
        told = gathered.join(bounds, "rep").join(fine.select("rep", "size", "parity", "nibbles"), "rep")
        return told.select("*", F.explode("keys").alias("key")).drop("keys")

    def links(self, sketches: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n, rep) of all rows with a set and an id, and all links (a, b) among representatives that components need."""
        full = sketches.filter("n > 0 and doc_id is not null")
        classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digests")  # a table of its own, so that the join can split a hot class
        membership = written(full.select("doc_id", "n", "digest").join(classes, "digest").select("doc_id", "n", "rep"), "classes")
        reps = membership.filter("doc_id = rep").select("rep").distinct()
        own = full.join(reps, F.col("doc_id") == F.col("rep")).select("rep", "n", "signature", "keys")
        stars = written(self._stars(own.select("rep", F.explode("keys").alias("key"))), "buckets")
        involved = stars.select("rep").distinct()
        members = written(involved.join(own.select("rep", "n", "signature"), "rep").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep"), "members")
        first = self.verified(self._pairs(stars), members)
        # an id with several texts ties their classes together
        ties = membership.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_b")).filter("a <> _b").select("doc_id", "a")
        first = first.unionAll(membership.join(ties, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")))
        opened = written(self._open(stars, components(first)).select("rep", "component").distinct(), "open")
        some = members.join(opened.select("rep"), "rep", "left_semi")
        bounds = written(self.bounded(some), "bounds")
        fine = written(self.fine_keys(some.join(bounds, "rep", "left_semi")).distinct(), "fine")
        keyed = fine.join(opened, "rep").select("rep", "component", F.explode("keys").alias("key"))
        # only fine buckets that still lie in several components, and of those only members of another component than the center's
        centers = keyed.groupBy("key").agg(F.min(F.struct("rep", "component")).alias("c"), F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x <> _y")
        stars = written(keyed.join(centers.select("key", F.col("c.rep").alias("center"), F.col("c.component").alias("_home")), "key").distinct(), "buckets")
        apart = self._pairs(stars.filter("component <> _home"))
        stars = stars.select("key", "rep", "center")
        second = first.unionAll(self.verified(apart, members))
        left = self._sides(self._open(stars, components(second)), bounds, fine)
        x, y = (left.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "_largest", "least", "most", "size", "parity", "nibbles"))) for s in "xy")
        places = self.fine * FINE_ROWS
        alike = differing(F.col("nibbles_x"), F.col("nibbles_y")) <= places - fewest_matches(self.percent / 100, places, self.miss, 16)
        fit = F.expr("rep_x < rep_y and component_x <> component_y and _largest_y >= least_x and n_y <= most_x and _largest_x >= least_y and n_x <= most_y")
        # a link's sets differ in (1 - t) of their union at most, which is (1 - t) / (1 + t) of the sum of their sizes
        close = (100 + self.percent) * least_difference(F.col("parity_x"), F.col("parity_y")) <= (100 - self.percent) * (F.col("size_x") + F.col("size_y"))
        near = x.join(y, (x["key"] == y["key"]) & fit & close & alike).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()
        return membership, second.unionAll(self.verified(near, members))

    def run(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row."""
        docs, ranks = ranked(docs, id_col)
        kind = dict(docs.dtypes)[id_col]
        docs = docs.select(F.col("_number").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        sketches = written(self.sketches(docs), "sketches")
        membership, links = self.links(sketches, docs)
        found = components(links)
        linked = membership.join(found, F.col("rep") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        alone = sketches.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        out = linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        for c in ("doc_id", "component_id"):
            if ranks is None:
                out = out.withColumn(c, F.col(c).cast(kind))
            else:
                out = out.join(ranks.select(F.col("_number").alias(c), F.col("_id").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
        return out.select("doc_id", "n_shingles", "component_id", "kept")
