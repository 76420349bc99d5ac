"""Operator 2: removal of byte strings that repeat across documents, by a depth-limited radix sort of suffixes.

Only the first `length` bytes of a suffix matter, so suffixes are sorted by
most-significant-digit passes over their bytes and never further: equal groups are then
exactly the repeated windows of `length` bytes. A pass goes on only with groups that still
hold several members.

* First digit: the window's smallest gram of `gram` bytes (its anchor). Equal windows have
  equal anchors at equal places, and neighbouring windows share one, so a run of windows
  travels as one stretch of bytes. Anchors dealt out by this digit meet in one task;
  those of a single document end here.
* Further digits, eight bytes each: the stretches of anchors that several documents hold are
  dealt out and sorted by their bytes. Stretches that are equal as a whole are settled together;
  the windows of the others are sorted by their bytes through `length`. All decisions
  compare bytes; hashes only choose the task.
* An anchor that HOT batches hold is dealt out by more bytes: its stretch is sent in two
  overlapping halves, each under the gram and half of what a window has besides.

A batch of documents combines its own equal stretches first, so a hot passage costs one stretch a
batch, and is told for each stretch which of its windows a smaller id holds (one bit each).

A byte is removed when a window that covers it also starts in a document with a smaller
id, judged on the input. Ids may be of any type that sorts. Nulls: a null text is empty; a
null id counts as the largest, so such rows lose what others hold and take nothing. Rows
that share an id do not remove each other's bytes. Texts shorter than `length` and empty
tables lose nothing. Very long texts are handled whole, in blocks. Other columns are
dropped, unless named in `carry`; they come back as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as ex
from tidemark.llm.common import flat, mixed, numbered, struct_of, trimmed, with_rest

LENGTH = 50
GRAM = 24
#: places whose windows are looked at together
BLOCK = 1 << 17
#: batches that share an anchor's gram before its stretches are dealt out by more bytes
HOT = 512
#: tasks that anchors are dealt out to at least
DIGITS = 64
BATCH_BYTES = 4 << 20


def grams(piece: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit mix of every gram of a stretch of bytes."""
    pair = piece[:-1].astype(np.uint16) | (piece[1:].astype(np.uint16) << np.uint16(8))
    four = pair[:-2].astype(np.uint32) | (pair[2:].astype(np.uint32) << np.uint32(16))
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    m = len(piece) - gram + 1
    h = np.zeros(m, np.uint64)
    for j in (*range(0, gram - 8, 8), gram - 8):
        h ^= eight[j : j + m]
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, gram's mix) of the runs of windows with one anchor, in texts that lie end to end.

    A run may be cut at a block's edge, which changes no window.
    """
    found, bits = [], np.uint64(20)  # a block's places have fewer bits, so that equal windows choose alike everywhere
    for s in range(0, len(data) - length + 1, block):
        e = min(s + block, len(data) - length + 1)
        h = grams(data[s : e + length - 1], gram)
        least = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)  # the place settles ties: the leftmost gram wins
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        a, b = np.searchsorted(ends, (s, e - 1), "right")
        stop = np.repeat(ends[a : b + 1], np.diff(np.concatenate([[s], np.minimum(ends[a : b + 1], e)])))
        fits = stop - np.arange(s, e) >= length
        cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (stop[1:] != stop[:-1]), True]
        first, last = np.flatnonzero(fits & (cut[:-1] | np.r_[True, ~fits[:-1]])), np.flatnonzero(fits & (cut[1:] | np.r_[~fits[1:], True]))
        found.append((first + s, last + s, anchor[first] + s, h[anchor[first]]))
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate(kinds))


def rows_of(data: np.ndarray, start: np.ndarray, size: np.ndarray | int, width: int) -> np.ndarray:
    """(rows, width) bytes from each start, 0 beyond each size."""
    spare = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(spare, width)[start]
    if np.ndim(size):
        out[np.arange(width)[None, :] >= size[:, None]] = 0
    return out


Digit = Callable[[int, np.ndarray], np.ndarray]


def radix_groups(digit: Digit, n: int, depth: int) -> np.ndarray:
    """The number of each row's group of equal rows: most significant digit first, on and on only where several rows are still alike.

    digit(k, rows) gives the k-th digit of rows as uint64.
    """
    out, done = np.empty(n, np.int64), 0
    rows, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(depth):
        if not len(rows):
            break
        d = digit(k, rows)
        order = np.lexsort((d, group)) if k else np.argsort(d, kind="stable")
        rows, group, d = rows[order], group[order], d[order]
        number = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (d[1:] != d[:-1])])
        several = np.bincount(number)[number] > 1
        alone = rows[~several]
        out[alone] = done + np.arange(len(alone))
        done += len(alone)
        rows, group = rows[several], number[several]
    if len(rows):
        out[rows] = done + np.cumsum(np.r_[False, group[1:] != group[:-1]])
    return out


def words(rows: np.ndarray) -> np.ndarray:
    """Bytes of rows as big-endian digits of eight bytes, digit by digit."""
    return np.ascontiguousarray(rows.view(">u8").astype(np.uint64).T)


def least_of(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row, the least value in its group."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, value)
    return least[group]


class Stretches:
    """A batch's stretches of bytes around anchors that several documents hold."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, number: np.ndarray, found: tuple[np.ndarray, ...], keep: np.ndarray, hot: np.ndarray, length: int, gram: int):
        first, last, anchor, mix = (x[keep] for x in found)
        hot = hot[keep]
        half = (length - gram) // 2
        span = gram + length - gram - half
        key, parts = mixed(mix, 41), []
        cool = np.flatnonzero(~hot)
        parts.append((first[cool], last[cool], key[cool]))
        if hot.any():
            right = np.flatnonzero(hot & (last >= anchor - half))
            parts.append((np.maximum(first, anchor - half)[right], last[right], self._mix(data, anchor[right], span, 43)))
            left = np.flatnonzero(hot & (first < anchor - half))
            parts.append((first[left], np.minimum(last, anchor - half - 1)[left], self._mix(data, anchor[left] - half - 1, gram + half + 1, 47)))
        self.first, self.last, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.number = number[np.searchsorted(ends, self.first, "right")]
        size = self.last + length - self.first
        width = -(-(2 * length - gram) // 8) * 8
        # equal stretches of the batch are one
        bits = [words(rows_of(data, self.first[a : a + 16384], size[a : a + 16384], width)) for a in range(0, len(key), 16384)]
        table = np.concatenate(bits, axis=1) if bits else np.zeros((width // 8, 0), np.uint64)
        group = radix_groups(lambda k, r: key[r] if k == 0 else size[r].astype(np.uint64) if k == 1 else table[k - 2, r], len(key), 2 + len(table))
        order = np.lexsort((self.number, group))
        lead = order[np.r_[True, group[order][1:] != group[order][:-1]]] if len(order) else order
        lead = lead[np.argsort(key[lead], kind="stable")]
        place = np.empty(len(lead), np.int64)
        place[group[lead]] = np.arange(len(lead))
        #: the distinct stretches in the order of their keys, and which of them each stretch is
        self.key, self.start, self.size, self.least, self.which = key[lead], self.first[lead], size[lead], self.number[lead], place[group]

    @staticmethod
    def _mix(data: np.ndarray, start: np.ndarray, size: int, salt: int) -> np.ndarray:
        h = np.zeros(len(start), np.uint64)
        for w in words(rows_of(data, start, np.full(len(start), size), -(-size // 8) * 8)):
            h = mixed(h ^ w, salt)
        return h


def texts_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch's texts end to end, where each ends, and the numbers of the documents."""
    data, ends = flat(part.column("text"))
    return data, ends, part.column("number").to_numpy()


SENT = "digit int, batch int, base long, keys binary, more binary, body binary"
REPLY = "batch int, step int, base long, answers binary"
SPANS = "text string, starts array<long>, stops array<long>"


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"digit": pa.int32(), "batch": pa.int32(), "step": pa.int32(), "base": pa.int64()}
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.binary())) for k, n in enumerate(names.split())], names.split())


def _squeezed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _restored(x: bytes, kind=np.uint8) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def distinct_keys(mix: np.ndarray, number: np.ndarray, batch_ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a batch's anchors in order, whether several documents hold each, and which of them each anchor has."""
    key = mixed(mix, 41) & ~np.uint64(0xFFFF)
    order, fresh = ex.distinct((key,))
    begin = np.flatnonzero(fresh)
    owner = number[np.searchsorted(batch_ends, first, "right")][order]
    several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin) if len(begin) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return key[order[begin]], several, which


def shared_anchors(part: pa.Table, hot: int) -> pa.Table:
    """Replies of one digit: which anchors several documents hold, and which very many batches hold."""
    rows = part.select(["batch", "base", "keys", "more"]).to_pylist()
    keys = [ex.keys_of(r["keys"], (6,))[0] for r in rows]
    flags = [np.unpackbits(np.frombuffer(r["more"], np.uint8))[: len(k)] for r, k in zip(rows, keys, strict=True)]
    order, fresh = ex.distinct((np.concatenate(keys),))
    begin = np.flatnonzero(fresh)
    held = np.diff(np.append(begin, len(order)))
    told = (held > 1) | (np.maximum.reduceat(np.concatenate(flags)[order], begin) > 0)
    group = np.cumsum(fresh) - 1
    code = np.empty(len(order), np.uint8)
    code[order] = (told.astype(np.uint8) + (held >= hot))[group]
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        mine = code[at : at + len(k)]
        at += len(k)
        if mine.any():
            out.append((r["batch"], 1, r["base"], _squeezed(mine)))
    del order, fresh, group, code, keys, flags
    trimmed()
    return _table(out, "batch step base answers")


def smaller_holders(part: pa.Table, length: int, gram: int) -> pa.Table:
    """Replies of one digit: for each stretch a bit for each of its windows, set where a smaller id than the batch's own holds the window."""
    rows = part.select(["batch", "base", "keys", "more", "body"]).to_pylist()
    key = np.concatenate([ex.keys_of(r["keys"], (6,))[0] for r in rows])
    counts = [len(r["keys"]) // 6 for r in rows]
    size = np.concatenate([np.frombuffer(r["more"], np.uint8, n).astype(np.int64) + length for r, n in zip(rows, counts, strict=True)])
    least = np.concatenate([ex.unpacked(r["more"][n:]) for r, n in zip(rows, counts, strict=True)])
    data = np.concatenate([_restored(r["body"]) for r in rows])
    keep = [(r["batch"], r["base"]) for r in rows]
    del rows
    start = np.cumsum(size) - size
    mask = np.zeros(len(key), np.uint64)
    # keys that a single stretch has are settled, the others are sorted by bytes
    order, fresh = ex.distinct((key,))
    lone = np.diff(np.append(np.flatnonzero(fresh), len(order))) == 1
    several = order[~lone[np.cumsum(fresh) - 1]]
    for some in _shares(several, key):
        mask[some] = _settled(data, key[some], start[some], size[some], least[some], length, gram)
    out, at = [], 0
    for (batch, base), n in zip(keep, counts, strict=True):
        mine = mask[at : at + n]
        at += n
        if mine.any():
            out.append((batch, 2, base, _squeezed(mine)))
    del key, size, least, data, start, mask, order, fresh
    trimmed()
    return _table(out, "batch step base answers")


def _shares(order: np.ndarray, key: np.ndarray, limit: int = 1 << 16) -> Iterable[np.ndarray]:
    """Rows in the order of their keys, in shares of whole keys of about `limit` rows, which bounds what a sort holds."""
    if not len(order):
        return
    ends = np.append(np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, len(order))
    at = 0
    while at < len(order):
        stop = int(ends[min(np.searchsorted(ends, at + limit), len(ends) - 1)])
        yield order[at:stop]
        at = stop


def _settled(data: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray, length: int, gram: int) -> np.ndarray:
    width = -(-(2 * length - gram) // 8) * 8
    table = words(rows_of(data, start, size, width))
    whole = radix_groups(lambda k, r: key[r] if k == 0 else size[r].astype(np.uint64) if k == 1 else table[k - 2, r], len(key), 2 + len(table))
    del table
    first = np.full(int(whole.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, whole, least)
    lead = np.full(len(first), -1)
    lead[whole] = np.arange(len(whole))  # one stretch of each kind
    # windows of the kinds that share their key with another kind
    order, fresh = ex.distinct((key[lead],))
    among = np.diff(np.append(np.flatnonzero(fresh), len(order)))[np.cumsum(fresh) - 1] > 1
    kinds = order[among]
    n_windows = size[lead] - length + 1
    least_window = np.repeat(first, n_windows)
    offset = np.cumsum(n_windows) - n_windows
    if len(kinds):
        n = n_windows[kinds]
        rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at, home = np.repeat(start[lead[kinds]], n) + rank, np.repeat(kinds, n)
        mix = np.repeat(key[lead[kinds]], n)
        spare = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(spare, 8)
        places = [*range(0, length - 8, 8), length - 8]

        def digit(k: int, r: np.ndarray) -> np.ndarray:
            return mix[r] if k == 0 else eight[at[r] + places[k - 1]].view(">u8").astype(np.uint64).reshape(-1)

        group = radix_groups(digit, len(at), 1 + len(places))
        least_window[offset[home] + rank] = least_of(group, first[home])
    # bit w of a stretch: its w-th window has a smaller holder than the stretch's own least id
    out = np.zeros(len(key), np.uint64)
    n = n_windows[whole]
    for w in range(int(n.max())):
        has = n > w
        out[has] |= (least_window[offset[whole[has]] + w] < least[has]).astype(np.uint64) << np.uint64(w)
    return out


def _answers(replies: pa.Table, step: int) -> list[tuple[int, bytes]]:
    return [(b, a) for s, b, a in zip(*(replies.column(c).to_pylist() for c in ("step", "base", "answers")), strict=True) if s == step]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, hot: int = HOT, carry: tuple[str, ...] = (), then: tuple[Callable[[pa.Table], pa.Table], str] | None = None) -> DataFrame:
    """(doc_id, text, starts array<long>, stops array<long>, rest): every row with its maximal removed runs, in bytes.

    rest is a struct of the columns in `carry`. `then` is a function of such rows, applied where
    they are made, and the schema of its columns between doc_id and rest.
    """
    if not 8 <= gram < length or length - gram > 62:
        raise ValueError("gram must have 8 bytes at least and be shorter than length by 1 to 62")
    parts, n = ex.batched(numbered(docs, id_col), id_col, text_col, batch_bytes, extra={"number": F.col("_number"), "rest": struct_of(carry)})
    digits = max(DIGITS, n // 4)

    def state(part):
        part = part.sort_by([("number", "ascending"), ("text", "ascending")])
        data, ends, number = texts_of(part)
        return part, data, ends, number, runs(data, ends, length, gram)

    def send_anchors(key, part):
        _, _, ends, number, found = state(part)
        keys, several, _ = distinct_keys(found[3], number, ends, found[0])
        cuts, rows = np.searchsorted(ex.digit_of(keys, digits), np.arange(digits + 1, dtype=np.uint64)), []
        for d in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[d], cuts[d + 1]
            rows.append((int(d), key[0].as_py(), int(a), ex.shortened(keys[a:b], 6), np.packbits(several[a:b]).tobytes(), None))
        del found, keys, several
        trimmed()
        return _table(rows, "digit batch base keys more body")

    def stretches(data, ends, number, found, replies):
        keys, _, which = distinct_keys(found[3], number, ends, found[0])
        told = np.zeros(len(keys), np.uint8)
        for base, answer in _answers(replies, 1):
            got = _restored(answer)
            told[base : base + len(got)] = got
        return Stretches(data, ends, number, found, told[which] > 0, told[which] > 1, length, gram)

    def send_stretches(key, part, replies):
        _, data, ends, number, found = state(part)
        s = stretches(data, ends, number, found, replies)
        cuts, rows = np.searchsorted(ex.digit_of(s.key, digits), np.arange(digits + 1, dtype=np.uint64)), []
        for d in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[d], cuts[d + 1]
            size = s.size[a:b]
            body = np.repeat(s.start[a:b] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            more = (size - length).astype(np.uint8).tobytes() + ex.packed(s.least[a:b])
            rows.append((int(d), key[0].as_py(), int(a), ex.shortened(s.key[a:b], 6), more, _squeezed(data[body])))
        del found, s, data
        trimmed()
        return _table(rows, "digit batch base keys more body")

    def close(key, part, replies):
        part, data, ends, number, found = state(part)
        s = stretches(data, ends, number, found, replies)
        del found
        mask = np.zeros(len(s.key), np.uint64)
        for base, answer in _answers(replies, 2):
            got = _restored(answer, np.uint64)
            mask[base : base + len(got)] = got
        count = s.last - s.first + 1
        full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
        mine = np.where(s.number > s.least[s.which], full, mask[s.which])  # the batch itself has a smaller holder, or is told of one
        depth = np.zeros(len(data) + 1, np.int32)
        for a in range(0, int(count.max()) if len(count) else 0):
            hit = s.first[(mine >> np.uint64(a)) & np.uint64(1) == 1] + a
            np.add.at(depth, hit, 1)
            np.add.at(depth, hit + length, -1)
        cover = np.concatenate([[0], (np.cumsum(depth)[:-1] > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(cover[1:] != cover[:-1])
        heads = np.concatenate([[0], ends[:-1]])
        inner = heads[(heads > 0) & (heads < len(data))]
        split = np.unique(inner[(cover[inner] == 1) & (cover[inner + 1] == 1)])  # removed runs end with their document
        a, b = np.sort(np.concatenate([edge[::2], split])), np.sort(np.concatenate([edge[1::2], split]))
        doc = np.searchsorted(ends, a, "right")
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ends)))]).astype(np.int32))
        spans = [pa.ListArray.from_arrays(offsets, pa.array(x - heads[doc], pa.int64())) for x in (a, b)]
        del s, depth, cover, mask, mine
        trimmed()
        out = pa.Table.from_arrays([part.column("doc_id"), part.column("text"), *spans, part.column("rest")], ["doc_id", "text", "starts", "stops", "rest"])
        return then[0](out) if then else out

    kind = dict(parts.dtypes)["doc_id"]
    asked = parts.groupBy("batch")
    one = asked.applyInArrow(send_anchors, SENT).groupBy("digit").applyInArrow(lambda part: shared_anchors(part, hot), REPLY)
    two = asked.cogroup(one.groupBy("batch")).applyInArrow(send_stretches, SENT).groupBy("digit").applyInArrow(lambda part: smaller_holders(part, length, gram), REPLY)
    return asked.cogroup(one.unionAll(two).groupBy("batch")).applyInArrow(close, with_rest(f"doc_id {kind}, {then[1] if then else SPANS}", parts))


def _kept(text: str, starts: list[int], stops: list[int]) -> bytes:
    data, out, at = text.encode(), [], 0
    for a, b in zip(starts, stops, strict=True):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _digests(rows: pa.Table) -> pa.Table:
    out = []
    for text, starts, stops in zip(*(rows.column(c).to_pylist() for c in ("text", "starts", "stops")), strict=True):
        kept, size = _kept(text, starts, stops), len(text.encode())
        out.append((size, size - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([rows.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)), rows.column("rest")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])


def _texts(rows: pa.Table) -> pa.Table:
    out = []
    for text, starts, stops in zip(*(rows.column(c).to_pylist() for c in ("text", "starts", "stops")), strict=True):
        out.append((_kept(text, starts, stops).decode("utf-8", "ignore") if starts else text, sum(stops) - sum(starts)))
    return pa.Table.from_arrays([rows.column("doc_id"), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), rows.column("rest")], ["doc_id", "text", "n_removed", "rest"])


def kept_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; options as of removed_spans()."""
    return removed_spans(docs, then=(_digests, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"), **options).drop("rest")


def kept_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text, n_removed, rest): the texts without their removed runs. A character that a run cuts is dropped whole."""
    return removed_spans(docs, then=(_texts, "text string, n_removed long"), **options)
