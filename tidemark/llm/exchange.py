"""Dealing hashed keys out by their leading digit, packed, and answering each batch of documents.

A corpus-wide question about billions of keys ("in which document does this key occur
first?", "how often does it occur?") would need a Spark row for each key. Here each batch
of documents first combines its own keys (a key occurs once per batch, however hot it is),
sorts them, and cuts the sorted run by the keys' leading digit into one packed row per
(batch, digit). All keys of a digit meet in one task, are sorted, and each batch gets back
the places of its keys that have an answer. There are never more rows than keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, trimmed

BATCH_BYTES = 2 << 20
#: batches whose text has as many keys as meet in one task: so many that packed rows stay few
DIGIT_BATCHES = 12
SENT = "digit int, batch int, base long, keys binary, low binary, more binary"
REPLY = "batch int, step int, base long, told binary, answers binary"


def batched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, extra: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(batch, doc_id, text, extra columns), where a batch holds about batch_bytes, and the number of batches.

    The batch depends on id and text alone, so it is the same wherever it is computed. A null text is empty.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c.alias(n) for n, c in (extra or {}).items()))
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // batch_bytes))
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("batch"), "*"), n


def ordered(part: pa.Table) -> pa.Table:
    """A batch in a fixed order, whatever order its rows arrived in."""
    return part.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if part.num_rows else part


def ids_of(part: pa.Table) -> np.ndarray:
    return part.column("doc_id").fill_null(NULL_ID).to_numpy().astype(np.int64)


def digit_of(key: np.ndarray, digits: int) -> np.ndarray:
    """The leading digit, in base `digits`, of uint64 keys."""
    return ((key >> np.uint64(32)) * np.uint64(digits)) >> np.uint64(32)


def distinct(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of keys (the first array leads), and where a new key begins in that order."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        fresh[1:] = ~same
    return order, fresh


def packed(values: np.ndarray) -> bytes:
    """int64 values as base, width and only as many low bytes as they need."""
    base = int(values.min()) if len(values) else 0
    delta = (values - base).astype("<u8")
    width = max(1, -(-int(delta.max()).bit_length() // 8)) if len(values) else 1
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + delta.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    base, width = int.from_bytes(data[:8], "little", signed=True), data[8]
    low = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :width] = low
    return wide.reshape(-1).view("<i8") + base


Widths = tuple[int, ...]


def shortened(key: np.ndarray, width: int) -> bytes:
    """The leading `width` bytes of each uint64."""
    return (key >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def send(batch: int, digits: int, keys: tuple[np.ndarray, ...], low: np.ndarray, more: np.ndarray, widths: Widths = (8,)) -> pa.Table:
    """Packed rows of a batch's distinct, sorted keys with two numbers for each. widths: leading bytes of each key number that count."""
    cuts = np.searchsorted(digit_of(keys[0], digits), np.arange(digits + 1, dtype=np.uint64))
    rows = []
    for d in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[d], cuts[d + 1]
        rows.append((int(d), batch, int(a), b"".join(shortened(k[a:b], w) for k, w in zip(keys, widths, strict=True)), packed(low[a:b]), packed(more[a:b] - low[a:b])))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["digit", "batch", "base", "keys", "low", "more"]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def keys_of(data: bytes, widths: Widths) -> list[np.ndarray]:
    """What send() has packed: one uint64 array for each number of the keys."""
    n, at, out = len(data) // sum(widths), 0, []
    for w in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(n, w)
        out.append(wide.reshape(-1).view("<u8"))
        at += n * w
    return out


def send_range(batch: int, digits: int, keys: tuple[np.ndarray, ...], values: np.ndarray, widths: Widths = (8,)) -> pa.Table:
    """send() of the smallest and largest value that each key occurs with."""
    order, fresh = distinct(keys)
    first = np.flatnonzero(fresh)
    if not len(first):
        return send(batch, digits, keys, values, values, widths)
    v = values[order]
    return send(batch, digits, tuple(k[order[first]] for k in keys), np.minimum.reduceat(v, first), np.maximum.reduceat(v, first), widths)


Answer = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def several(low: np.ndarray, high: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which groups have several values, and the smallest of each."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    smallest, largest = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
    return smallest != largest, smallest


def total(low: np.ndarray, high: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the first numbers of each group, told where a group has several rows; a single row knows its sum."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.diff(np.append(start, len(group))) > 1, np.add.reduceat(low, start)


def resolved(sent: DataFrame, step: int, answer: Answer = several, widths: Widths = (8,), answered: bool = True) -> DataFrame:
    """For each batch, which of its keys have an answer (bits) and, if `answered`, the answers."""

    def run(part: pa.Table) -> pa.Table:
        counts, keys, low, more = [], [], [], []
        for k, a, b in zip(part.column("keys").to_pylist(), part.column("low").to_pylist(), part.column("more").to_pylist(), strict=True):
            keys.append(keys_of(k, widths))
            low.append(unpacked(a))
            more.append(unpacked(b))
            counts.append(len(low[-1]))
        columns = tuple(np.concatenate([k[w] for k in keys]) for w in range(len(widths)))
        low_all = np.concatenate(low)
        order, fresh = distinct(columns)
        group = np.cumsum(fresh) - 1
        told, value = answer(low_all[order], (low_all + np.concatenate(more))[order], group)
        yes, what = np.empty(len(order), bool), np.empty(len(order), np.int64)
        yes[order], what[order] = told[group], value[group]
        out, at = [], 0
        for n, batch, base in zip(counts, part.column("batch").to_pylist(), part.column("base").to_pylist(), strict=True):
            mine = yes[at : at + n]
            if mine.any():
                out.append((batch, step, base, np.packbits(mine).tobytes(), packed(what[at : at + n][mine]) if answered else None))
            at += n
        del order, fresh, group, yes, what, keys, columns, low, low_all, more
        trimmed()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["batch", "step", "base", "told", "answers"])

    return sent.groupBy("digit").applyInArrow(run, REPLY)


def answers(replies: pa.Table, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, answers) of one step from the replies to a batch; without answers these are 0."""
    places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, base, told, a in zip(*(replies.column(c).to_pylist() for c in ("step", "base", "told", "answers")), strict=True):
        if s == step:
            places.append(np.flatnonzero(np.unpackbits(np.frombuffer(told, np.uint8))) + base)
            values.append(unpacked(a) if a is not None else np.zeros(len(places[-1]), np.int64))
    return np.concatenate(places), np.concatenate(values)
