"""Operator 8: language-model scores by prediction by partial matching, beside a smoothed word-unigram base.

The model is a trie of byte contexts up to ORDER symbols deep. Its counts are gathered
from all training documents; a document is scored with that trie (`scored`), or with a
trie that learns while it reads that document alone (`adaptive`).

* Alphabet: symbol 0 frames a text (start context and end), 1..256 are the byte values.
  All contexts of all orders are kept. A context and its next symbol are one number, a
  code; the trie is the counts of the distinct codes, from which those of the shorter
  contexts follow.
* The trie is a partitioned table. Codes of all batches are summed where their hash puts
  them (`exchange`), then dealt by their last two context symbols, so that a part holds
  all contexts from ORDER down to two; only the counts of pairs of symbols, 257 * 257 at
  most, are broadcast. Each batch gets the final probabilities of its own distinct codes.
* Escape estimation (method D): in a context with total T and U distinct symbols, a seen
  symbol has (count - 1/2) / T and the escape U / 2 / T.
* Symbol exclusion: after an escape, the shorter context leaves out the symbols that the
  longer one has seen. What is left out depends on the longer context alone, so every
  code has one final probability.

Base: words and one end per text are tokens; their training counts are gathered with
`exchange` (a hot word costs one key per batch of documents), as 64-bit hashes of words.

Nulls: a null text is empty and has one token, its end; a null id is a training id.
Without training documents all counts are 0 and the trie is uniform. Repeated rows count
each time. Very long texts are scored whole. Other columns are dropped.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as ex
from tidemark.llm.common import slices, texts, trimmed, word_numbers

ORDER = 4
SYMBOLS = 257
FRAME = 0
FOLDS = 10
SMOOTHING = 0.1


def in_fold(doc_id: object) -> bool:
    """Whether a document is held out of the training set."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class Alphabet:
    def __init__(self, histogram: np.ndarray | None = None):
        """All byte values are symbols of their own, whatever their frequency."""
        self.symbol = np.arange(1, SYMBOLS)
        #: log10 probability of a byte, given its symbol
        self.spelling = np.zeros(256)

    def coded(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of texts, each followed by the frame; the context of each; and the text of each."""
        data = np.frombuffer(b"".join(v + b"\0" for v in values), np.uint8)
        sizes = np.array([len(v) + 1 for v in values], np.int64)
        ends = np.cumsum(sizes)
        s = self.symbol[data]
        s[ends - 1] = FRAME
        place = np.arange(len(s)) - np.repeat(ends - sizes, sizes)
        context = np.zeros(len(s), np.int64)
        for k in range(ORDER, 0, -1):
            before = np.zeros(len(s), np.int64)
            before[k:] = s[: len(s) - k]
            before[place < k] = FRAME
            context = context * SYMBOLS + before
        return s, context, np.repeat(np.arange(len(values)), sizes)


def histogram(values: list[bytes]) -> np.ndarray:
    return np.bincount(np.frombuffer(b"".join(values), np.uint8), minlength=256)


def codes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """context * SYMBOLS + symbol of every symbol of texts, and the text of each."""
    symbol, context, text = Alphabet().coded(values)
    return context * SYMBOLS + symbol, text


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums, those above 0."""
    keys, at = np.unique(keys, return_inverse=True)
    n = np.bincount(at, weights=counts, minlength=len(keys))
    return keys[n > 0], n[n > 0]


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold the wanted ones, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trie:
    """Final probabilities of codes, from sparse counts."""

    def __init__(self, index: np.ndarray, count: np.ndarray, deep_index: np.ndarray, deep_count: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        """index: codes of contexts one short of full depth; deep_index: those of full depth; pairs: those of one symbol, where the others are a part of a trie."""
        self.levels = []
        for k in range(ORDER + 1):  # a suffix of a context is the context modulo a power of the alphabet
            keys, n = (deep_index, deep_count) if k == ORDER else pairs if pairs is not None and k < 2 else (index, count)
            keys, n = summed(keys % SYMBOLS ** (k + 1), n)
            seen, start = np.unique(keys // SYMBOLS, return_index=True)
            #: counts that the symbols of a context have in the next shorter one
            below = np.zeros(len(keys))
            if k:
                at, has = found(self.levels[-1][0], keys % SYMBOLS**k)
                below[has] = self.levels[-1][1][at[has]]
            sums = [np.add.reduceat(x, start) if len(start) else np.zeros(0) for x in (n, below)]
            self.levels.append((keys, n, seen, sums[0], np.diff(np.append(start, len(keys))), sums[1]))

    def log_chances(self, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of each code."""
        out, left = np.zeros(len(wanted)), np.ones(len(wanted), bool)
        longer_kinds, longer_sum = np.zeros(len(wanted)), np.zeros(len(wanted))
        for k in range(ORDER, -1, -1):
            keys, n, seen, totals, kinds, below = self.levels[k]
            code = wanted % SYMBOLS ** (k + 1)
            at, has = found(seen, code // SYMBOLS)
            total, different, passed = (np.where(has, x[at], 0) if len(seen) else np.zeros(len(wanted)) for x in (totals, kinds, below))
            fresh = np.where(has, different - longer_kinds, 0)
            rest = np.where(has, total - longer_sum, 0)
            given = np.where(different < SYMBOLS, 0.5, 0.0)  # what each seen symbol gives to the escape
            at, here = found(keys, code)
            hit = left & here
            out[hit] += np.log10((n[at[hit]] - given[hit]) / rest[hit])
            left &= ~here
            escaped = left & (rest > 0)
            out[escaped] += np.log10(fresh[escaped] * given[escaped] / rest[escaped])
            longer_kinds, longer_sum = np.where(has, different, longer_kinds), passed
        out[left] -= np.log10(SYMBOLS - longer_kinds[left])
        return out

    @property
    def log10(self) -> np.ndarray:
        """All probabilities of the contexts of full depth, a row for each."""
        seen = self.levels[ORDER][2]
        return self.log_chances((seen[:, None] * SYMBOLS + np.arange(SYMBOLS)).reshape(-1)).reshape(-1, SYMBOLS)

    def scores(self, alphabet: Alphabet, values: list[bytes]) -> np.ndarray:
        """log10 probability of each whole text, its end included."""
        if not values:
            return np.zeros(0)
        symbol, context, text = alphabet.coded(values)
        distinct, at = np.unique(context * SYMBOLS + symbol, return_inverse=True)
        return np.bincount(text, weights=self.log_chances(distinct)[at], minlength=len(values))


def adaptive_bits(text: bytes) -> float:
    """Code length in bits of one text, its end included, when the trie learns from the text itself, symbol by symbol. The time is linear in the text."""
    tables: list[dict[tuple, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
    past, total = (FRAME,) * ORDER, 0.0
    for symbol in (*(b + 1 for b in text), FRAME):
        contexts = [past[ORDER - k :] for k in range(ORDER + 1)]
        gone: set[int] = set()
        for k in range(ORDER, -1, -1):
            seen = tables[k].get(contexts[k])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in gone} if gone else seen
            given, rest = 0.5 if len(seen) < SYMBOLS else 0.0, sum(left.values())
            if symbol in left:
                total -= math.log2((left[symbol] - given) / rest)
                break
            if left:
                total -= math.log2(len(left) * given / rest)
            gone.update(seen)
        else:
            total += math.log2(SYMBOLS - len(gone))
        for k in range(ORDER + 1):
            seen = tables[k].setdefault(contexts[k], {})
            seen[symbol] = seen.get(symbol, 0) + 1
        past = (*past[1:], symbol)
    return total


def adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, bits): the adaptive code length of every document, each from itself alone. A null text is empty."""
    docs = texts(docs, id_col, text_col)

    def run(batches):
        for b in slices(batches, "text", 1 << 18):
            values = [t.encode() for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), pa.array([len(v) for v in values], pa.int64()), pa.array([adaptive_bits(v) for v in values], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "bits"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, bits double")


#: A code has under 48 bits, and so has its key: the same number, shuffled by steps that can be undone.
_BITS, _HALF = np.uint64((1 << 48) - 1), np.uint64(24)
_ODD = (0xFB21C651E98D, 0xE8FEB86659FD)


def keys_of_codes(code: np.ndarray) -> np.ndarray:
    """The keys, in the leading 48 bits."""
    x = code.astype(np.uint64)
    for odd in _ODD:
        x = (x * np.uint64(odd)) & _BITS
        x ^= x >> _HALF
    return x << np.uint64(16)


def codes_of_keys(key: np.ndarray) -> np.ndarray:
    x = key >> np.uint64(16)
    for odd in reversed(_ODD):
        x = x ^ (x >> _HALF)
        x = (x * np.uint64(pow(odd, -1, 1 << 48))) & _BITS
    return x.astype(np.int64)


WIDTHS = (6,)


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Codes of contexts of one symbol in all training documents, and their counts."""

    def run(batches):
        held = np.zeros(SYMBOLS**2, np.int64)
        for b in slices(batches, "text", 2 << 20):
            if values := [t.encode() for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if not in_fold(i)]:
                held += np.bincount(codes(values)[0] % SYMBOLS**2, minlength=SYMBOLS**2)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["k", "n"])

    got = texts(docs, id_col, text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return got.column("k").to_numpy(), got.column("n").to_numpy()


def chances(sent: DataFrame, digits: int, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(digit, h, chance): log10 probability of every distinct code that batches have sent."""
    held = sent.sparkSession.sparkContext.broadcast(pairs)  # 257 * 257 counts at most

    def total(part):
        """Distinct codes of one digit with their training counts, 0 for those of held-out texts alone."""
        keys = np.concatenate([ex.keys_of(k, WIDTHS)[0] for k in part.column("keys").to_pylist()]) << np.uint64(16)
        low = np.concatenate([ex.unpacked(a) for a in part.column("low").to_pylist()])
        order, fresh = ex.distinct((keys,))
        first = np.flatnonzero(fresh)
        return pa.table({"code": pa.array(codes_of_keys(keys[order[first]])), "n": pa.array(np.add.reduceat(low[order], first))})

    def worked(part):
        code, n = part.column("code").to_numpy(), part.column("n").to_numpy()
        known = n > 0
        trie = Trie(code[known], n[known], code[known], n[known], held.value)
        h = keys_of_codes(code)
        out = pa.table({"digit": pa.array(ex.digit_of(h, digits).astype(np.int32)), "h": pa.array(h.view(np.int64)), "chance": pa.array(trie.log_chances(code))})
        trimmed()
        return out

    shares = max(64, digits * 4)
    suffix = F.floor(F.col("code") / SYMBOLS) % SYMBOLS**2
    table = sent.groupBy("digit").applyInArrow(total, "code long, n long")
    return table.withColumn("share", F.pmod(F.xxhash64(suffix), F.lit(shares))).groupBy("share").applyInArrow(worked, "digit int, h long, chance double")


def told(sent: DataFrame, table: DataFrame) -> DataFrame:
    """Replies to batches (step 2): the chances of their codes, in the order of the keys."""

    def run(part, known):
        h = known.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, chance = h[order], known.column("chance").to_numpy()[order]
        rows = part.select(["batch", "base", "keys"]).to_pylist()
        held = [chance[np.searchsorted(h, ex.keys_of(r["keys"], WIDTHS)[0] << np.uint64(16))].tobytes() for r in rows]
        columns = [[r["batch"] for r in rows], [2] * len(rows), [r["base"] for r in rows], [None] * len(rows), held]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["batch", "step", "base", "told", "answers"])

    return sent.groupBy("digit").cogroup(table.groupBy("digit")).applyInArrow(run, ex.REPLY)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = ex.BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    pairs = pair_counts(docs, id_col, text_col)
    parts, n = ex.batched(docs, id_col, text_col, batch_bytes)

    def words(part):
        part = ex.ordered(part)
        values = [t.encode() for t in part.column("text").to_pylist()]
        numbers, sizes, digests = word_numbers(values)
        learn = np.array([not in_fold(i) for i in part.column("doc_id").to_pylist()], bool)
        order = np.argsort(digests)  # of distinct words only
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, text = rank[numbers], np.repeat(np.arange(len(values)), sizes)
        own = np.bincount(place, weights=learn[text], minlength=len(order)).astype(np.int64)
        return part, values, digests[order], own, place, text, sizes, learn

    def emit(key, part):
        _, _, keys, own, _, _, _, _ = words(part)
        return ex.send(key[0].as_py(), n, (keys,), own, own)

    def own_codes(part):
        """Distinct codes of a batch in the order of their hashes, the hashes, and the place and text of each code."""
        values = [t.encode() for t in part.column("text").to_pylist()]
        code, text = codes(values)
        kept, at = np.unique(code, return_inverse=True)
        h = keys_of_codes(kept)
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return kept[order], h[order], place[at], text

    def emit_codes(key, part):
        part = ex.ordered(part)
        code, h, place, text = own_codes(part)
        learn = np.array([not in_fold(i) for i in part.column("doc_id").to_pylist()], bool)
        counts = np.bincount(place, weights=learn[text], minlength=len(code)).astype(np.int64)
        sent = ex.send(key[0].as_py(), n, (h,), counts, counts, WIDTHS)
        del code, h, place, text
        trimmed()
        return sent

    def close(key, part, replies):
        part, values, keys, own, place, text, sizes, learn = words(part)
        places, found = ex.answers(replies, 1)
        own[places] = found
        count = own[place]
        known = np.bincount(text, weights=count > 0, minlength=len(values)).astype(np.int64)
        logs = np.bincount(text, weights=np.log10(own + SMOOTHING)[place], minlength=len(values))
        code, _, at, of = own_codes(part)
        each = np.zeros(len(code))
        for step, base, held in zip(*(replies.column(c).to_pylist() for c in ("step", "base", "answers")), strict=True):
            if step == 2:
                chance = np.frombuffer(held, np.float64)
                each[base : base + len(chance)] = chance
        score = np.bincount(of, weights=each[at], minlength=len(values))
        columns = [part.column("doc_id"), pa.array(~learn), pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(logs), pa.array(score)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known_words", "word_logs", "score"])

    def tally(part):
        """Distinct words with a training count, and all training words, of one digit."""
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in part.column("keys").to_pylist()])
        low = np.concatenate([ex.unpacked(a) for a in part.column("low").to_pylist()])
        order, fresh = ex.distinct((keys,))
        summed = np.add.reduceat(low[order], np.flatnonzero(fresh))
        return pa.table({"kinds": pa.array([int((summed > 0).sum())], pa.int64()), "words": pa.array([int(summed.sum())], pa.int64())})

    kind = dict(parts.dtypes)["doc_id"]
    asked = parts.groupBy("batch")
    sent = asked.applyInArrow(emit, ex.SENT)
    asked_codes = asked.applyInArrow(emit_codes, ex.SENT)
    replies = ex.resolved(sent, 1, ex.total).unionAll(told(asked_codes, chances(asked_codes, n, pairs)))
    each = asked.cogroup(replies.groupBy("batch")).applyInArrow(close, f"doc_id {kind}, held_out boolean, n_tokens long, known_words long, word_logs double, score double")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    ends = docs.agg(F.count(F.when(~held, 1)).alias("ends")).scalar()
    tallied = sent.groupBy("digit").applyInArrow(tally, "kinds long, words long").agg(F.struct(F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).alias("t")).scalar()
    each = each.withColumn("ends", ends).withColumn("tally", tallied)
    tokens = F.col("tally.words") + F.col("ends")
    kinds = F.col("tally.kinds") + (F.col("ends") > 0).cast("long")
    base = F.col("word_logs") + F.log10(F.col("ends") + F.lit(SMOOTHING)) - F.col("n_tokens") * F.log10(tokens + F.lit(SMOOTHING) * (kinds + 1))
    return each.select("doc_id", "held_out", "n_tokens", (F.col("known_words") + (F.col("ends") > 0).cast("long")).alias("n_known"), tokens.alias("train_tokens"), base.alias("base_score"), "score")
