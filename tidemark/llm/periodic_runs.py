"""Operator 13: periodic runs of words, and texts without the repetitions.

A run is a longest stretch of consecutive words with smallest period q that is at least `least`
words and `times` periods long. For a stretch of words, suffix trees (Ukkonen) of it and of its
reversal are toured once, so that the longest common extension of two places, to the right or to
the left, is a range minimum over the tour, found in constant time. The longest Lyndon word at
each place, for the order of the words and for the opposite one, is a candidate for the root of a
run (each run has one among them); extended both ways, it gives the run.

Trees are built only of the stretches that can hold a run. Inside a run of period q all word
triples but the last ones occur again within q words; `stretches` finds, for each power of two,
where so many consecutive triples do. It compares hashes, which are equal for equal triples, so
it never loses a run; it only lets more through.

Rows: a null text has no words. A row with a null id is never altered by `looped`. Repeated rows are
judged one by one. Texts with fewer words than a run can have no run: their four columns of the best
run are null. An empty table gives no rows. Columns of the input other than id and text are left
behind. A document is worked on by one task, whose memory grows with the document's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import Numbers, mixed, slices, trimmed

LEAST, TIMES = 6, 4
NEVER = np.iinfo(np.int64).max
#: Places of the tour that one entry of the table of minima stands for.
BLOCK = 16


@dataclass
class SuffixTree:
    """Suffix tree of symbols that end in a 0 that occurs nowhere else. Node 0 is the root."""

    depth: list[int]  # symbols from the root to a node
    suffix: list[int]  # where the suffix of a leaf starts; -1 for inner nodes
    parent: np.ndarray
    kids: list[int]  # children of all nodes, by symbol
    first: list[int]  # where those of a node start in kids; the end of the last at the end


def suffix_tree(symbols: list[int]) -> SuffixTree:
    """Ukkonen's construction, left to right."""
    n, base = len(symbols), max(symbols) + 1
    head, tail, link, depth, suffix = [0], [0], [0], [0], [-1]
    child: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, c in enumerate(symbols):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = i
            key = node * base + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(head)
                parent_of_leaf = node
            else:
                span = tail[below] - head[below]
                if length >= span:  # the active place lies beyond this edge
                    edge += span
                    length -= span
                    node = below
                    continue
                middle = head[below] + length
                if symbols[middle] == c:
                    if unlinked:
                        link[unlinked] = node
                    length += 1
                    break
                inner = child[key] = len(head)
                head.append(head[below])
                tail.append(middle)
                link.append(0)
                depth.append(depth[node] + length)
                suffix.append(-1)
                head[below] = middle
                child[inner * base + symbols[middle]] = below
                child[inner * base + c] = len(head)
                parent_of_leaf = inner
            if unlinked:
                link[unlinked] = parent_of_leaf
            unlinked = 0 if below is None else parent_of_leaf
            head.append(i)
            tail.append(n)
            link.append(0)
            depth.append(n - (i - waiting + 1))
            suffix.append(i - waiting + 1)
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    keys = np.fromiter(child.keys(), np.int64, len(child))
    below = np.fromiter(child.values(), np.int64, len(child))
    order = np.argsort(keys)
    parent = np.full(len(head), -1)
    parent[below] = keys // base
    first = np.searchsorted(keys[order] // base, np.arange(len(head) + 1))
    return SuffixTree(depth, suffix, parent, below[order].tolist(), first.tolist())


def tour(tree: SuffixTree) -> np.ndarray:
    """The nodes of the tree in the order of a walk around it, each again after each of its children."""
    kids, parent, at, stop = tree.kids, tree.parent.tolist(), tree.first[:-1], tree.first[1:]
    seen, v = [], 0
    while v >= 0:
        seen.append(v)
        p = at[v]
        if p < stop[v]:
            at[v] = p + 1
            v = kids[p]
        else:
            v = parent[v]
    return np.array(seen)


class Extensions:
    """Longest common extensions of the places of a stretch: the depth of the lowest node above two leaves."""

    def __init__(self, tree: SuffixTree) -> None:
        walk = tour(tree)
        met = np.empty(len(tree.depth), np.int64)
        met[walk[::-1]] = np.arange(len(walk))[::-1]  # the first time that a node is met
        suffix = np.array(tree.suffix)
        leaves = np.flatnonzero(suffix >= 0)
        self.place = np.empty(len(leaves), np.int64)
        self.place[suffix[leaves]] = met[leaves]
        depths = np.array(tree.depth)[walk]
        self.depths = np.concatenate([depths, np.full(-len(depths) % BLOCK, NEVER)])
        blocks = self.depths.reshape(-1, BLOCK)
        self.until = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(axis=1)]
        while (step := 1 << (len(self.table) - 1)) * 2 <= len(blocks):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a on equal those from b on; a and b differ."""
        a, b = self.place[a], self.place[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        first, last = low // BLOCK + 1, high // BLOCK
        found = np.minimum(self.since[low], self.until[high])
        between = np.flatnonzero(first < last)
        level = np.frexp((last - first)[between])[1] - 1
        for k in np.unique(level).tolist():
            q = between[level == k]
            found[q] = np.minimum(found[q], np.minimum(self.table[k][first[q]], self.table[k][last[q] - (1 << k)]))
        near = np.flatnonzero(first > last)  # both in one block
        found[near] = self.depths[low[near]]
        for k in range(1, BLOCK):
            near = near[low[near] + k <= high[near]]
            found[near] = np.minimum(found[near], self.depths[low[near] + k])
        return found


def ranks(tree: SuffixTree, opposite: bool) -> list[int]:
    """The place of each suffix in the order of the symbols or in the opposite one; a suffix that ends comes first in both."""
    kids, first, suffix = tree.kids, tree.first, tree.suffix
    out, stack, k = [0] * (max(suffix) + 1), [0], 0
    while stack:
        v = stack.pop()
        if suffix[v] >= 0:
            out[suffix[v]] = k
            k += 1
            continue
        below = kids[first[v] : first[v + 1]]
        if not opposite:
            below.reverse()  # the smallest symbol is popped first
        elif suffix[below[0]] >= 0 and tree.depth[below[0]] == tree.depth[v] + 1:
            below = [*below[1:], below[0]]  # only the end symbol follows here
        stack.extend(below)
    return out


def lyndon_ends(rank: list[int]) -> np.ndarray:
    """For each place but the last, where its longest Lyndon word ends: at the next suffix that is smaller."""
    n = len(rank)
    out, open_ = [0] * n, []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out[: n - 1], np.int64)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    if n < least:
        return np.zeros((0, 3), np.int64)
    symbols = np.unique(ids, return_inverse=True)[1] + 1
    ahead, back = suffix_tree([*symbols.tolist(), 0]), suffix_tree([*symbols[::-1].tolist(), 0])
    i = np.arange(n)
    i, j = np.concatenate([i, i]), np.concatenate([lyndon_ends(ranks(ahead, False)), lyndon_ends(ranks(ahead, True))])
    right = Extensions(ahead).at(i, j)
    left = Extensions(back).at(n - i, n - j)
    start, length, period = i - left, j + right - (i - left), j - i
    ok = length >= np.maximum(least, times * period)
    return np.unique(np.stack([start[ok], length[ok], period[ok]], 1)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(ids: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one places of the stretches of sequences that lie end to end that hold all their runs whole.

    In a run of period q, the triples up to q + 3 words before its end occur again q words on.
    For q in (half, full], at least max(least - 3, (times - 1) * (half + 1) - 2) consecutive ones do.
    """
    n = len(ids)
    if n < 3:
        return ends - np.diff(ends, prepend=0), ends
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    key = mixed(ids[:-2].astype(np.uint64), 1)
    for k in (1, 2):
        key = mixed(key ^ ids[k : n - 2 + k].astype(np.uint64), 1 + k)
    key = mixed(key ^ owner[:-2].astype(np.uint64), 4)
    order = np.argsort(key, kind="stable")
    again = np.full(n, NEVER)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    again[order[same]] = order[same + 1] - order[same]
    again[:-2][owner[:-2] != owner[2:]] = NEVER  # a triple that no one sequence holds
    first, last = [], []
    full = 1
    longest = int(np.diff(ends, prepend=0).max())
    while True:
        half = full // 2
        need = max((times - 1) * (half + 1) - 2, least - 2 - full)
        if need < 1:  # so short a run need not hold a triple twice
            return ends - np.diff(ends, prepend=0), ends
        near = np.concatenate([[False], again <= full, [False]])
        turns = np.flatnonzero(near[1:] != near[:-1])
        a, b = turns[::2], turns[1::2]
        long = b - a >= need
        first.append(a[long])
        last.append(np.minimum(b[long] + full + 2, ends[owner[a[long]]]))
        if full * times >= longest:
            break
        full *= 2
    a, b = np.concatenate(first), np.concatenate(last)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(order) else b
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] >= b[:-1]) | (owner[a[1:]] != owner[a[:-1]])
    begin = np.flatnonzero(fresh)
    return a[begin], np.maximum.reduceat(b, begin) if len(begin) else b


def looped(ids: np.ndarray, h: int) -> np.ndarray:
    """Places of the words of a sequence altered to hold a run: from a place on, its next p words again and again."""
    n, g = len(ids), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _best(found: np.ndarray) -> tuple[int, int, int, int] | tuple[None, None, None, None]:
    """The run of the greatest exponent; of equal ones the first, then the one with the smallest period."""
    best = None
    for s, length, q in found.tolist():
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return (*best, 1000 * best[1] // best[2]) if best else (None,) * 4


OUT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", altered: Column | None = None, least: int = LEAST, times: int = TIMES, keep_text: bool = False) -> DataFrame:
    """One row per document: its number of runs, the one of the greatest exponent, a digest of all runs and one of the text without repetitions.

    altered: a number by which a document's words are looped first (see `looped`), null for none. keep_text adds `runs`, an
    array of (start, length, period), and `collapsed`, the text itself.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.lit(None) if altered is None else altered).cast("long").alias("h"))
    whole = [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())] if keep_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out = _described([t.encode() for t in batch.column(1).to_pylist()], batch.column(2).to_pylist(), least, times, keep_text)
            columns = [pa.array(c, pa.string() if k >= 5 else pa.int64()) for k, c in enumerate(out[:7])]
            columns += [pa.array(c, kind) for c, (_, kind) in zip(out[7:], whole, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [*OUT, *(n for n, _ in whole)])
        trimmed()

    fields = [StructField(n, StringType() if n.endswith("sha256") else LongType()) for n in OUT[1:]]
    if keep_text:
        fields += StructType.fromDDL("runs array<struct<start: long, length: long, period: long>>, collapsed string").fields
    return rows.mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *fields]))


def _described(values: list[bytes], altered: list[int | None], least: int, times: int, keep_text: bool) -> list[list]:
    """The columns of OUT after the id, for texts as bytes."""
    number, words, ids = Numbers(), [], []
    for value, h in zip(values, altered, strict=True):
        w = value.split()  # at the bytes 9 to 13 and 32
        x = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        if h is not None and len(w):
            place = looped(x, h)
            w, x = [w[k] for k in place.tolist()], x[place]
        words.append(w)
        ids.append(x)
    ends = np.cumsum([len(x) for x in ids])
    joined = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    first, last = stretches(joined, ends, least, times) if len(joined) else (ends[:0], ends[:0])
    found = [[] for _ in values]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        k = int(np.searchsorted(ends, a, "right"))
        r = runs_of(joined[a:b], least, times)
        if len(r):
            found[k].append(r + [a - (ends[k] - len(ids[k])), 0, 0])
    out: list[list] = [[] for _ in range(9 if keep_text else 7)]
    for w, parts in zip(words, found, strict=True):
        r = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        n_kept = np.zeros(len(w) + 1, np.int64)
        np.add.at(n_kept, r[:, 0] + r[:, 2], 1)
        np.add.at(n_kept, r[:, 0] + r[:, 1], -1)
        kept = w if not len(r) else [w[k] for k in np.flatnonzero(np.cumsum(n_kept[:-1]) == 0).tolist()]
        text = b" ".join(kept)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in r.tolist())
        row = [len(r), *_best(r), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()]
        if keep_text:
            row += [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r.tolist()], text.decode()]
        for column, v in zip(out, row, strict=True):
            column.append(v)
    return out


def loop_number(id_col: str = "doc_id", one_in: int = 10) -> Column:
    """crc32 of an id's decimal form where `one_in` divides it; null elsewhere and for a null id."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.when(h % one_in == 0, h)
