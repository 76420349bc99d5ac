"""Operator 7: piece encoding by sampled segmentations without replacement, and decoding.

A document's lattice is the chain of its pre-tokens' lattices; a path is a segmentation and
its probability the product of its pieces' unigram probabilities over their sum. Every path
has a Gumbel-perturbed log probability; the k largest are k samples without replacement.
They are found by A* search: a region is all paths that share a prefix but leave out some
of its next pieces, and the largest perturbed value in a region is a Gumbel number of its
total mass, cut off at the value of the region that it came from. Popping the best region
yields its best path by one descent, and the path splits the region into new ones, one at
each of its nodes. Region bounds are exact, so k pops give the k samples, and the best
region that is left gives the (k + 1)-th value, hence each sample's inclusion score
1 - exp(-exp(log_prob - value)).

Lattices are built once for each distinct pre-token and kept for the next slices of a
task, up to a bound; descents run over all documents of a slice at once. Random numbers are
hashes of the row key, the sample and the place in the document, and sums are taken within
a word or a document, so a row's samples do not depend on how rows are dealt out.

Whole texts are segmented. Nulls: a null or empty text has one empty segmentation; a null
id is a key like any other. Documents with fewer than k segmentations get all of them, with
inclusion 1. Rows with equal ids and texts get equal samples. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import mixed, slices, texts, trimmed
from tidemark.llm.pieces import DEFAULT_MODEL, Vocabulary, pretokens, vocabulary

SAMPLES = 2
SLICE_BYTES = 1 << 18
#: Letters of distinct pre-tokens whose lattices a task keeps after a slice.
KEPT_LETTERS = 1 << 19
#: Of two regions of a document, one whose log mass is larger by this has the larger bound, for -log(u) lies between 2**-53 and 38 (it is 0 once in 2**53 draws).
REACH = 42.0


class Transitions:
    """Vocabulary.transitions() as a table that is looked up by a hash of (state, letter), and the states of first letters (-1: none)."""

    def __init__(self, vocab: Vocabulary):
        keys, to, self.ids, self.scores = vocab.transitions()
        first = keys < 1 << 21
        self.opening = np.full(1 << 21, -1, np.int32)
        self.opening[keys[first]] = to[first]
        keys, to = keys[~first], to[~first].astype(np.int32)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):  # whoever finds its place taken tries the next one
            free = self.key[at[left]] < 0
            self.key[at[left[free]]] = keys[left[free]]
            mine = self.key[at[left]] == keys[left]
            self.to[at[left[mine]]] = to[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, keys: np.ndarray) -> np.ndarray:
        """The state that each (state << 21 | letter) leads to, -1 where there is none."""
        at, out = self.slot(keys), np.full(len(keys), -1, np.int64)
        found = self.key[at]
        hit = found == keys
        out[hit] = self.to[at[hit]]
        left = np.flatnonzero(~hit & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


@lru_cache(2)
def _transitions(path: str) -> Transitions:
    return Transitions(vocabulary(path))


def put(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """`held` with `new` from place `used` on, in a larger array if it does not fit."""
    if used + len(new) > len(held):
        held = np.concatenate([held[:used], np.empty(len(new) + used // 2, held.dtype)])
    held[used : used + len(new)] = new
    return held


class Lattices:
    """The lattices of distinct pre-tokens: nodes are places between letters, edges are pieces.

    A word's lattice is the same whichever words are added with it, so lattices are kept between
    slices, which changes no result; what is kept is bounded by `bounded`.
    """

    END = (1 << 21) - 1  # stands after each word's last letter; no letter

    def __init__(self, vocab: Vocabulary, transitions: Transitions):
        self.vocab, self.transitions = vocab, transitions
        self.clear()

    def clear(self, room: int = 0) -> None:
        """Forgets all lattices and makes room for so many letters (memory that is not used yet costs none)."""
        self.known, self.letters, self.nodes, self.edges, self.room = {}, 0, 0, 0, room
        self.root = np.empty(room, np.int64)  # of a word
        self.begin, self.degree = np.empty(2 * room, np.int32), np.empty(2 * room, np.int32)  # of a node: its first edge, and how many it has
        self.end, self.piece = np.empty(4 * room, np.int32), np.empty(4 * room, np.int32)  # of an edge
        #: log probability of each edge given its start, that of its start's other edges, and the share of its start's edges up to it
        self.log_p, self.rest, self.upto = np.empty(4 * room), np.empty(4 * room), np.empty(4 * room)

    def bounded(self, letters: int) -> None:
        """Forgets all lattices if they have more letters than that (a letter takes some 100 bytes)."""
        if self.letters > 2 * letters or self.room != letters:
            self.clear(letters)
        elif self.letters > letters:  # what has been used is used again
            self.known, self.letters, self.nodes, self.edges = {}, 0, 0, 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; lattices of words not met before are added."""
        if fresh := list(set(words).difference(self.known)):
            self._add(fresh)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[str]) -> None:
        ids, scores = self.transitions.ids, self.transitions.scores
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest_first = np.argsort(-sizes, kind="stable")
        words, sizes = [words[k] for k in longest_first.tolist()], sizes[longest_first]
        letters = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        last = np.cumsum(sizes + 1) - 1
        letters[last] = self.END
        # nodes are numbered by their distance from the end of their word, so those of one distance lie together
        distance = np.repeat(last, sizes + 1) - np.arange(len(letters))
        before = np.concatenate([[0], np.cumsum(len(words) - np.concatenate([[0], np.cumsum(np.bincount(sizes))[:-1]]))])
        node = before[distance] + np.repeat(np.arange(len(words)), sizes + 1)
        del distance
        degree, levels = np.zeros(len(letters), np.int64), []
        at, state, size = np.arange(len(letters)), self.transitions.opening[letters].astype(np.int64), 0
        single = np.zeros(0, bool)
        while len(at):
            if size:
                state = self.transitions.next((state << 21) | letters[at + size])
            real = np.flatnonzero(state >= 0)
            at, state = at[real], state[real]
            size += 1
            whole = np.flatnonzero(ids[state] >= 0)
            place, piece = at[whole], state[whole]
            start = node[place]
            rank = degree[start]
            degree[start] = rank + 1
            levels.append((start, rank, node[place + size], ids[piece], scores[piece]))
            if size == 1:
                single = degree > 0
        bare = np.flatnonzero(~single[node] & (letters != self.END))
        some_letters = letters[bare]
        spell = {c: len(self.vocab.fallback(chr(c))) for c in np.unique(some_letters).tolist()}
        weight = np.array([spell[c] for c in some_letters.tolist()], float) * self.vocab.byte_score
        start = node[bare]
        levels.append((start, degree[start], node[bare + 1], -some_letters - 1, weight))  # spelled out later
        degree[start] += 1
        offset = np.concatenate([[0], np.cumsum(degree)])
        end, piece, weight, places = np.empty(offset[-1], np.int64), np.empty(offset[-1], np.int32), np.empty(offset[-1]), []
        while levels:
            start, rank, to, name, score = levels.pop(0)
            place = offset[start] + rank
            end[place], piece[place], weight[place] = to, name, score
            places.append((start, place))
        # backward sums, by the distance of a node from its word's end
        mass = np.zeros(len(letters))
        for low, high in zip(before[1:-1].tolist(), before[2:].tolist(), strict=True):
            a, b = offset[low], offset[high]
            value = weight[a:b] + mass[end[a:b]]
            begin = offset[low:high] - a
            top = np.maximum.reduceat(value, begin)
            total = np.add.reduceat(np.exp(value - np.repeat(top, degree[low:high])), begin)
            mass[low:high] = top + np.log(total)
        log_p = np.minimum(0.0, weight + mass[end] - np.repeat(mass, degree))
        share, upto, total = np.exp(log_p), np.empty(len(log_p)), np.zeros(len(letters))
        for start, place in places:
            upto[place] = total[start] = total[start] + share[place]
        upto /= np.repeat(np.maximum(1e-300, total), degree)
        upto[offset[1:][degree > 0] - 1] = 2.0  # the last edge takes what is left
        root = np.empty(len(words), np.int64)
        root[longest_first] = before[sizes] + np.arange(len(words)) + self.nodes
        self.root = put(self.root, len(self.known), root)
        self.begin, self.degree = put(self.begin, self.nodes, offset[:-1] + self.edges), put(self.degree, self.nodes, degree)
        self.end, self.piece = put(self.end, self.edges, end + self.nodes), put(self.piece, self.edges, piece)
        rest = np.log(np.maximum(1e-300, -np.expm1(log_p)))
        rest[offset[:-1][degree == 1]] = -np.inf
        self.log_p, self.rest, self.upto = put(self.log_p, self.edges, log_p), put(self.rest, self.edges, rest), put(self.upto, self.edges, upto)
        self.nodes, self.edges, self.letters = self.nodes + len(letters), self.edges + len(log_p), self.letters + int(sizes.sum())

    def out(self, edge: int) -> range:
        """All edges from the start of an edge."""
        node = np.searchsorted(self.begin[: self.nodes], np.int32(edge), "right") - 1  # places without edges come before the next one with some
        return range(int(self.begin[node]), int(self.begin[node] + self.degree[node]))


_PLACE, _STEP = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def salted(key: np.ndarray, sample: int, use: int) -> np.ndarray:
    """Row keys as hashes for a sample and a use."""
    return mixed(key + np.uint64((sample * 8 + use) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def fraction(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(key: np.ndarray, sample: int, a: np.ndarray, b: np.ndarray | int, use: int) -> np.ndarray:
    """Numbers in (0, 1) from the row key, the sample and a place."""
    return fraction(salted(key, sample, use) + a.astype(np.uint64) * _PLACE + np.atleast_1d(b).astype(np.uint64) * _STEP)


def row_key(doc_id: object) -> int:
    return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")


class Sampler:
    """k segmentations without replacement of each of some documents."""

    def __init__(self, keys: np.ndarray, cut: list[list[str]], vocab: Vocabulary, transitions: Transitions, lattices: Lattices | None = None):
        self.vocab, self.lattices = vocab, lattices or Lattices(vocab, transitions)
        self.word = self.lattices.numbers(list(chain.from_iterable(cut)))
        counts = np.array([len(w) for w in cut], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # of a document: its first occurrence
        self.doc = np.repeat(np.arange(len(cut)), counts)
        self.keys = keys
        self.rank = np.arange(len(self.word)) - np.repeat(self.first[:-1], counts)

    def descend(self, occurrence: np.ndarray, node: np.ndarray, skipped: np.ndarray, sizes: np.ndarray, sample: int) -> list[tuple]:
        """Random paths from nodes to the end of their words, by step: (occurrence, edge). Sets the occurrences' path sizes; `skipped` pieces come before a path."""
        lattices, found = self.lattices, []
        ways = lattices.degree[node]
        on = np.flatnonzero(ways)
        occurrence, node, ways = occurrence[on], node[on], ways[on]
        h = salted(self.keys, sample, 0)[self.doc[occurrence]] + self.rank[occurrence].astype(np.uint64) * _PLACE + skipped[occurrence].astype(np.uint64) * _STEP
        while len(node):
            edge = lattices.begin[node]
            at = np.flatnonzero(ways > 1)  # from the others there is but one way
            mine, u = edge[at], fraction(h[at])
            at_mine = np.flatnonzero(u >= lattices.upto[mine])
            while len(at_mine):
                mine[at_mine] += 1
                at_mine = at_mine[u[at_mine] >= lattices.upto[mine[at_mine]]]
            edge[at] = mine
            found.append((occurrence, edge))
            node = lattices.end[edge]
            ways = lattices.degree[node]
            over = occurrence[ways == 0]
            sizes[over] = skipped[over] + len(found)
            on = np.flatnonzero(ways)
            occurrence, node, ways, h = occurrence[on], node[on], ways[on], h[on] + _STEP
        return found

    def samples(self, k: int) -> list[dict]:
        """One dict a sample: docs, perturbed, log_prob, the edges of each path end to end with their cuts, and where each occurrence's edges begin."""
        n, lattices, words = len(self.first) - 1, self.lattices, len(self.word)
        regions: list[list[tuple]] = [[] for _ in range(n)]  # (value, sample, place in its path, edges left out)
        out: list[dict] = []
        docs, value = np.arange(n), -np.log(-np.log(uniform(self.keys, 0, np.zeros(n, np.int64), 0, 1)))
        occurrence, node, skipped, sizes = np.arange(words), lattices.root[self.word], np.zeros(words, np.int64), np.zeros(words, np.int64)
        left_out: list[tuple] = [()] * n
        prefixes: list[np.ndarray] = []
        for j in range(k):
            found = self.descend(occurrence, node, skipped, sizes, j)
            first = np.concatenate([[0], np.cumsum(sizes)])
            edge, to = np.empty(first[-1], np.int32), first[:-1] + skipped
            for step, (where, e) in enumerate(found):
                edge[to[where] + step] = e
            del found, to
            begin, stop = first[self.first[docs]], first[self.first[docs + 1]]
            for b, held in zip(begin.tolist(), prefixes, strict=bool(j)):
                edge[b : b + len(held)] = held
            out.append({"docs": docs, "perturbed": value, "edge": edge, "begin": begin, "stop": stop, "first": first})
            self._split(regions, out[-1], left_out, j, k - j)
            if j + 1 < k:
                docs, value, prefixes, occurrence, node, skipped, sizes, left_out = self._popped(regions, out, j + 1)
                if not len(docs):
                    break
        self.next_value = np.array([r[0][0] if r else -np.inf for r in regions])
        return out

    def _split(self, regions: list, path: dict, left_out: list[tuple], sample: int, keep: int) -> None:
        """Sums paths up, and adds the regions that they leave (at each node, its other pieces): the `keep` best of each document, for no more can ever be popped.

        Only regions whose mass is within REACH of the `keep` largest ones at the beginning of a path get their draws.
        """
        lattices, edge, docs = self.lattices, path["edge"], path["docs"].tolist()
        mass, after = np.zeros(len(edge) + 1), lattices.log_p[edge]
        total, least = np.zeros(len(docs)), np.full(len(docs), -np.inf)
        cuts = list(zip(path["begin"].tolist(), path["stop"].tolist(), strict=True))
        for d, (a, b) in enumerate(cuts):
            if b > a:  # sums over a document alone, so that they do not depend on the others
                np.cumsum(after[a:b], out=after[a:b])
                total[d] = after[b - 1]
        path["log_prob"] = total
        mass[1:] = after
        mass[path["begin"]] = 0.0  # the sum before each node
        mass[:-1] += lattices.rest[edge]
        window = max(64, keep)
        for d, (a, b) in enumerate(cuts):
            if left_out[d]:  # where a region was split, what it had left out stays out
                place, gone = left_out[d]
                e = int(edge[a + place])
                open_p = sum(math.exp(lattices.log_p[x]) for x in lattices.out(e) if x not in gone and x != e)
                before = after[a + place - 1] if place else 0.0
                mass[a + place] = before + math.log(open_p) if open_p > 0 else -math.inf
                mass[a : a + place] = -math.inf  # those nodes belong to older regions
                a += place
            if b - a >= keep:
                part = mass[a : min(b, a + window)]
                least[d] = (np.partition(part, -keep)[-keep] if keep > 1 else part.max()) - REACH
        sizes = path["stop"] - path["begin"]
        at = np.flatnonzero((mass[:-1] >= np.repeat(least, sizes)) & (mass[:-1] > -np.inf))
        del after
        owner = np.searchsorted(path["stop"], at, "right")
        occurrence = np.searchsorted(path["first"], at, "right") - 1
        draw = -np.log(uniform(self.keys[path["docs"][owner]], sample, self.rank[occurrence], at - path["first"][occurrence], 2))
        with np.errstate(divide="ignore"):
            late = np.log(draw) - mass[at]  # the smallest have the largest bounds
        parts = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        for d, (x, y) in enumerate(zip(parts[:-1], parts[1:], strict=True)):
            mine = regions[docs[d]]
            place, gone = left_out[d] or (-1, ())
            best = np.argpartition(late[x:y], keep)[:keep] + x if y - x > keep else range(x, y)
            for c in best:
                bound, t = float(-np.logaddexp(-path["perturbed"][d], late[c])), int(at[c]) - cuts[d][0]
                mine.append((bound, sample, t, (*(gone if t == place else ()), int(edge[at[c]]))))
            mine.sort(key=lambda r: -r[0])
            del mine[keep:]

    def _popped(self, regions: list, out: list[dict], sample: int) -> tuple:
        """The best region of each document that has one: the prefix of its path with its next piece, and what is to be drawn anew."""
        lattices, words = self.lattices, len(self.word)
        docs = np.array([d for d, mine in enumerate(regions) if mine], np.int64)
        popped = [regions[d].pop(0) for d in docs.tolist()]
        of, place = np.array([r[1] for r in popped], np.int64), np.array([r[2] for r in popped], np.int64)
        begin, split, step = (np.zeros(len(docs), np.int64) for _ in range(3))
        for j, o in enumerate(out):
            mine = np.flatnonzero(of == j)
            begin[mine] = o["first"][self.first[docs[mine]]]
            at = begin[mine] + place[mine]
            split[mine] = np.searchsorted(o["first"], at, "right") - 1
            step[mine] = at - o["first"][split[mine]]
        u = uniform(self.keys[docs], sample, self.rank[split], step, 3)
        prefixes, sizes = [], np.zeros(words, np.int64)
        starts = [np.diff(o["first"]) for o in out]
        for d, a, s, b, x, (_, j, t, gone) in zip(self.first[docs].tolist(), begin.tolist(), split.tolist(), step.tolist(), u.tolist(), popped, strict=True):
            held = out[j]["edge"][a : a + t + 1].copy()
            open_edges = [e for e in lattices.out(held[-1]) if e not in gone]
            p = list(accumulate(math.exp(lattices.log_p[e]) for e in open_edges))
            held[-1] = open_edges[min(bisect_right(p, x * p[-1]), len(open_edges) - 1)]
            prefixes.append(held)
            sizes[d:s] = starts[j][d:s]
            sizes[s] = b + 1
        skipped, later = np.zeros(words, np.int64), np.full(len(self.first) - 1, words)
        skipped[split], later[docs] = step + 1, split
        fresh = np.flatnonzero(np.arange(words) > later[self.doc])
        node = np.concatenate([lattices.end[np.array([p[-1] for p in prefixes], np.int64)], lattices.root[self.word[fresh]]])
        return docs, np.array([r[0] for r in popped]), prefixes, np.concatenate([split, fresh]), node, skipped, sizes, [(r[2], r[3]) for r in popped]

    def ids(self, edge: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths and where each path ends; letters without pieces are spelled in bytes."""
        piece = self.lattices.piece[edge]
        bare = np.flatnonzero(piece < 0)
        if not len(bare):
            return piece, stop
        spelled = {c: [self.vocab.byte_ids[x] for x in self.vocab.fallback(chr(-c - 1))] for c in np.unique(piece[bare]).tolist()}
        sizes = np.ones(len(piece), np.int64)
        sizes[bare] = [len(spelled[c]) for c in piece[bare].tolist()]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(piece, sizes)
        where = np.repeat(ends[:-1][bare], sizes[bare]) + np.arange(int(sizes[bare].sum())) - np.repeat(np.cumsum(sizes[bare]) - sizes[bare], sizes[bare])
        flat[where] = np.concatenate([spelled[c] for c in piece[bare].tolist()])
        return flat, ends[stop]


OUT = "sample int, pieces array<int>, log_prob double, perturbed double, inclusion double"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, sample, pieces, log_prob, perturbed, inclusion): `samples` distinct segmentations of every document."""
    docs = texts(docs, id_col, text_col)

    def run(batches):
        vocab, transitions = vocabulary(model), _transitions(model)
        lattices = Lattices(vocab, transitions)
        lattices.clear(KEPT_LETTERS)
        for b in slices(batches, "text", SLICE_BYTES):
            ids = b.column("doc_id").to_pylist()
            s = Sampler(np.array([row_key(i) for i in ids], np.uint64), [pretokens(t) for t in b.column("text").to_pylist()], vocab, transitions, lattices)
            for j, o in enumerate(s.samples(samples)):
                with np.errstate(over="ignore"):
                    inclusion = -np.expm1(-np.exp(np.minimum(700.0, o["log_prob"] - s.next_value[o["docs"]])))
                flat, ends = s.ids(o["edge"], o["begin"], o["stop"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends] if len(ends) else [0], pa.int32()), pa.array(flat, pa.int32()))
                columns = [b.column("doc_id").take(pa.array(o["docs"])), pa.array(np.full(len(o["docs"]), j), pa.int32()), lists, pa.array(o["log_prob"]), pa.array(o["perturbed"]), pa.array(inclusion)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sample", "pieces", "log_prob", "perturbed", "inclusion"])
                del flat, lists, columns, o
            del s
            lattices.bounded(KEPT_LETTERS)
        del lattices
        trimmed()

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {OUT}")


def decoded(samples: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Adds `text`, the text of each row's pieces, to (doc_id, sample, pieces, log_prob, perturbed, inclusion)."""

    def run(batches):
        spelled = pa.array(vocabulary(model).spelled, pa.binary())
        for b in slices(batches, "pieces", 4 << 20):
            lists = b.column("pieces")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            pieces = spelled.take(lists.flatten())  # the bytes of all rows end to end
            cuts = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(sizes)])]
            data = pieces.buffers()[2].to_pybytes() if len(pieces) else b""
            found = [data[x:y].decode("utf-8", "replace") for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "text"])

    kind = dict(samples.dtypes)["doc_id"]
    return samples.mapInArrow(run, f"doc_id {kind}, {OUT}, text string")
