"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny resemblance to the document as a
whole. So items are partitioned by the size of their shingle set (powers of two), and for
each partition documents are cut into overlapping stretches of twice its largest size:
whatever window an item fills lies whole in one stretch. Stretches and items get binned
MinHashes (the smallest hash of each bin); an item is a candidate of a document when a
bin of one of its stretches agrees. Bins are plentiful against a stretch, so a shared
shingle is lost with probability 1 / 16 at most. Of an item only the minima of its rarest
shingles (by the number of items that hold them) are kept: so many that SPARE of them lie in any document
with enough of the item. Items that share a template are thus told apart by what is their own,
and documents with that template meet only items that it fills almost to the threshold. Partitions of
small items take as many salted rounds as keep the chance to miss an item under 1e-6.
Candidates are verified by exact containment: shared distinct shingles / distinct
shingles of the item, over the whole document.

Items are a table: their minima are joined with those of the documents. Documents are read
once, whatever the number of items. Only two filters are broadcast (which hashes are an item's
minimum, and which are an item's shingle): bitmaps of FILTER_BITS bits at most. More items
than they can tell apart let more hashes through to the join, and change no result.

Texts: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `width` words. An item with fewer
words is one shingle of all its words, and is held by documents in which they follow each other
anywhere; only where such items exist are documents read in shingles of that many words too. Null or empty items and documents match
nothing. Null ids are kept as they are. Repeated rows, and rows that share an id, are judged each. Other columns
are dropped, unless named in `carry`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mixed, slices, spread, struct_of, with_rest, written
from tidemark.llm.near_dedup import shingles_of

WIDTH = 5
CONTAINMENT = 0.8
MISS = 1e-6
#: Kept shingles of an item that a document with enough of it has: all are lost with a probability of 16 ** -SPARE.
SPARE = math.ceil(-math.log(MISS) / math.log(16))
FILTER_BITS = 1 << 26


def largest_of(power: int) -> int:
    return (2 << power) - 1


def bins_of(power: int) -> int:
    return 1 << (16 * largest_of(power) - 1).bit_length()


def rounds_of(power: int, containment: float) -> int:
    """Salted rounds for items of 2 ** power shingles or more."""
    return math.ceil(-math.log(MISS) / (min(SPARE, math.ceil(containment * (1 << power) - 1e-9)) * math.log(16)))


def salted(hashes: np.ndarray, power: int, turn: int) -> np.ndarray:
    return mixed(hashes, 101 + power * 64 + turn)


def smallest(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin that has one; a hash's low bits are its bin."""
    order = np.lexsort((hashes, hashes & np.uint64(bins - 1)))
    bin_of = (hashes & np.uint64(bins - 1))[order]
    return hashes[order][np.r_[True, bin_of[1:] != bin_of[:-1]]]


class Filter:
    """A bitmap of the leading bits of hashes."""

    def __init__(self, words: np.ndarray, bits: int):
        self.bits, self.bytes = bits, words.astype("<u8").view(np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def filter_of(hashes: DataFrame, column: str) -> Filter:
    """The filter of a column of long arrays; its size follows the number of hashes up to a fixed bound."""
    each = hashes.select(F.explode(column).alias("h"))
    n = each.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (4096 * n).bit_length())).bit_length() - 1
    at = each.select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Filter(out, bits)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """(item, item_id, n, words, shingles) of every item with a shingle; item numbers the rows, words is the width of its shingles."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", 1 << 18):
            values = [t.encode() for t in b.column("text").to_pylist()]
            hashes, counts = shingles_of(values, width)
            sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
            some = [k for k, s in enumerate(sets) if len(s)]
            words = [min(width, len(values[k].split(maxsplit=width))) for k in some]
            columns = [pa.array(np.arange(serial, serial + len(some))), b.column("item_id").take(pa.array(some, pa.int64())), pa.array([len(sets[k]) for k in some], pa.int64()), pa.array(words, pa.int32()), _lists([sets[k] for k in some])]
            serial += len(some)
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "n", "words", "shingles"])

    return items.mapInArrow(run, f"item long, item_id {dict(items.dtypes)['item_id']}, n long, words int, shingles array<long>")


def item_signatures(items: DataFrame, width: int, containment: float) -> DataFrame:
    """(item, item_id, n, words, power, shingles, minima) of every item with a shingle: minima are those of its rarest shingles."""
    sets = written(item_sets(items, width), "item-sets")
    each = sets.select("item", "n", F.explode("shingles").alias("h"))
    rarity = each.join(each.groupBy("h").agg(F.count("*").alias("held")), "h")
    # without these, fewer shingles are left than a document must share, less SPARE
    enough = F.expr(f"cast(n - ceil({containment}D * n - 1e-9D) + {SPARE} as int)")
    rare = rarity.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("held", "h"))).alias("by")).select("item", F.slice("by", F.lit(1), enough)["h"].alias("rare"))
    names = ["item", "item_id", "n", "words", "power", "shingles", "minima"]

    def run(batches):
        for b in batches:
            powers = [n.bit_length() - 1 for n in b.column("n").to_pylist()]
            rare = [np.asarray(r, np.int64).view(np.uint64) for r in b.column("rare").to_pylist()]
            minima = [np.concatenate([smallest(salted(r, p, t), bins_of(p)) for t in range(rounds_of(p, containment))]) for r, p in zip(rare, powers, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), pa.array(powers, pa.int32()), b.column("shingles"), _lists(minima)], names)

    return sets.join(rare, "item").mapInArrow(run, f"item long, item_id {dict(items.dtypes)['item_id']}, n long, words int, power int, shingles array<long>, minima array<long>")


def agreeing(hashes: np.ndarray, counts: np.ndarray, power: int, turn: int, known: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash): minima of bins of documents' stretches that may be minima of items. A bin's minimum is sought only in stretches with a hash that may be one."""
    values, ends, largest = salted(hashes, power, turn), np.cumsum(counts), largest_of(power)
    hits = np.flatnonzero(known.holds(values))
    if not len(hits):
        return hits, values[hits]
    doc = np.searchsorted(ends, hits, "right")
    begin = ends - counts
    block = (hits - begin[doc]) // largest
    # a stretch is two blocks, so each block lies in two
    stretches = np.unique(np.concatenate([np.stack([doc, block]), np.stack([doc, np.maximum(0, block - 1)])], axis=1), axis=1)
    first = begin[stretches[0]] + stretches[1] * largest
    last = np.minimum(ends[stretches[0]], first + 2 * largest) - 1
    at, stretch = spread(first, last)
    mine = values[at]
    bin_of = mine & np.uint64(bins_of(power) - 1)
    order = np.lexsort((mine, bin_of, stretch))
    lead = np.r_[True, (bin_of[order][1:] != bin_of[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])]
    least = np.zeros(len(values), bool)
    least[at[order[lead]]] = True
    good = least[hits]
    return doc[good], values[hits[good]]


def candidates(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (row, item) with a common minimum. A minimum in very many rows is a skewed key that adaptive joins split."""
    key = lambda df, one: df.select(one, F.explode("minima").alias("h"))
    return key(rows, "row").join(key(index, "item"), "h").select("row", "item").distinct()


def searched(docs: DataFrame, items: DataFrame, width: int, containment: float, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, minima, shingles, rest) of documents (doc_id, text, rest) that may hold an item, of all, with their text, if `whole`; and (row, item_id, n_item_shingles, n_shared) of those that do.

    Both are read from written tables.
    """
    index = written(item_signatures(items, width, containment), "items")
    session = docs.sparkSession
    kinds = [(r["words"], r["power"]) for r in index.select("words", "power").distinct().collect()]  # width * 63 at most
    powers, short = sorted({p for _, p in kinds}), sorted({w for w, _ in kinds if w < width})
    held = session.sparkContext.broadcast((filter_of(index, "minima"), filter_of(index, "shingles")))

    def run(batches):
        serial = TaskContext.get().partitionId() << 40
        minima, shingle = held.value
        for b in slices(batches, "text", 1 << 17):
            values = [(t or "").encode() for t in b.column("text").to_pylist()]
            hashes, counts = shingles_of(values, width)
            found = [agreeing(hashes, counts, p, t, minima) for p in powers for t in range(rounds_of(p, containment))]
            less = [shingles_of(values, w) for w in short]
            found += [agreeing(*both, 0, t, minima) for both in less for t in range(rounds_of(0, containment))]
            pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.uint64), *(f[k].astype(np.uint64) for f in found)]) for k in range(2)]), axis=1)
            cuts = np.searchsorted(pairs[0], np.arange(b.num_rows + 1, dtype=np.uint64))
            runs = [(h, np.cumsum(c) - c, np.cumsum(c)) for h, c in ((hashes, counts), *less)]
            keys = [pairs[1, x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            sets = []
            for row, k in enumerate(keys):
                own = np.unique(np.concatenate([h[x[row] : y[row]] for h, x, y in runs])) if len(k) else hashes[:0]
                sets.append(own[shingle.holds(own)] if len(own) else own)
            text = b.column("text") if whole else pa.nulls(b.num_rows, pa.string())
            columns = [pa.array(np.arange(serial, serial + b.num_rows)), b.column("doc_id"), text, _lists(keys), _lists(sets), b.column("rest")]
            serial += b.num_rows
            out = pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text", "minima", "shingles", "rest"])
            yield out if whole else out.filter(pa.array(np.array([len(k) > 0 for k in keys], bool)))

    rows = written(docs.mapInArrow(run, with_rest(f"row long, doc_id {dict(docs.dtypes)['doc_id']}, text string, minima array<long>, shingles array<long>", docs)), "searched")
    pairs = candidates(rows, index)
    full = pairs.join(rows.select("row", F.col("shingles").alias("held")), "row").join(index.select("item", "item_id", "n", "shingles"), "item")
    shared = full.withColumn("n_shared", F.size(F.array_intersect("held", "shingles")).cast("long"))
    dirty = shared.filter(F.col("n_shared") >= containment * F.col("n") - 1e-9)
    return rows, dirty.select("row", "item_id", F.col("n").alias("n_item_shingles"), "n_shared")


def _sides(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), struct_of(carry).alias("rest"))
    return docs, items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every document that holds enough of an item."""
    rows, dirty = searched(*_sides(docs, items, id_col, text_col, item_col, item_text_col), width, containment, False)
    found = dirty.join(rows.select("row", "doc_id"), "row")
    return found.select("doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, containment: float = CONTAINMENT, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs that hold no item, with the columns in `carry` (all if None)."""
    names = carry or docs.columns
    others = tuple(c for c in names if c not in (id_col, text_col))
    rows, dirty = searched(*_sides(docs, items, id_col, text_col, item_col, item_text_col, others), width, containment, True)
    clean = rows.join(dirty.select("row").distinct(), "row", "left_anti")
    return clean.select(*(F.col({id_col: "doc_id", text_col: "text"}.get(c, f"rest.{c}")).alias(c) for c in names))
