"""Operator 4: quality grades by ordinal cumulative-link regression on hashed text.

A document's grade is ordered: 0 toxic and of low quality, 1 one of the two, 2 neither
(quality + 1 - toxic). One weight vector is shared by all grades and ordered thresholds cut
its score: P(grade >= k) = sigmoid(score - threshold[k]). Selection uses the tail probability
of the best grade; the expected grade is the sum of the tails.

Features are hashed and binary: the distinct words of the whole text (runs of letters,
A-Z lower-cased), their first 4 and 6 bytes, and a few shapes of it (shares of upper case, digits and each kind of
punctuation, variety of words for a text of that length), each in coarse steps.

Fitting takes a bounded sample: the SAMPLE labelled rows with the smallest hash of their
id, so that it is the same wherever it runs. Features that fewer than MIN_DOCS of them hold,
or that are no sign of a grade (score test under SIGNAL), get no weight. Scoring covers every document, whole.

Nulls: a null text is empty; labels with a null id, quality or toxic are not used, and
for ids labelled twice both rows count. Without usable labels every document gets the best
grade, for nothing speaks against it. Null ids, repeated rows and ties are scored like
any other row. Other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discarded, slices, string_hashes, struct_of, texts, trimmed, with_rest, word_places, written

BITS = 18
GRADES = 3
SAMPLE = 20_000
MIN_DOCS = 4
SIGNAL = 4.0
KEEP = 0.65
_SHAPES = 1 << 12

PREFIXES = (4, 6)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.r_[np.arange(65), np.arange(65, 91) + 32, np.arange(91, 256)].astype(np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MARKS = np.flatnonzero(~_LETTER & ~_SPACE & (np.arange(256) > 32) & ~np.isin(np.arange(256), np.arange(48, 58)))
_STEPS = np.array([0.0, 0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5])


def features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the features that texts have, text by text, and the number of each text."""
    sizes = np.array([len(v) for v in values], np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    text = np.repeat(np.arange(len(values)), sizes)
    ends = np.cumsum(sizes)
    found = [_shapes(data, text, sizes)]
    if len(data):
        start, length, words = word_places(data, ends, _LETTER)
        if len(start):
            low, owner = _LOWER[data], np.repeat(np.arange(len(values)), words)
            parts = []
            for k, size in enumerate((None, *PREFIXES)):
                some = np.ones(len(start), bool) if size is None else length > size
                hashes = string_hashes(low, start[some], length[some] if size is None else np.full(int(some.sum()), size), 37 + k)
                parts.append((owner[some] << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
            distinct = np.unique(parts[0])
            key = np.unique(np.concatenate(parts))
            kinds = np.bincount(distinct >> BITS, minlength=len(values))
            found.append(np.stack([key >> BITS, (key & ((1 << BITS) - 1)) + _SHAPES], 1))
            long = np.log2(words + 1).astype(np.int64)
            variety = (10 * kinds / np.maximum(1, words)).astype(np.int64)
            found.append(np.stack([np.arange(len(values)), 2048 + long * 16 + variety], 1))
    rows = np.concatenate(found)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    return rows[:, 1], np.bincount(rows[:, 0], minlength=len(values))


def _shapes(data: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(text, feature) of shares in steps: upper case, digits, letters, white space, line ends, each mark."""
    n = len(sizes)
    counts = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256)
    total = np.maximum(1, sizes)[:, None]
    shares = np.stack([counts[:, 65:91].sum(1), counts[:, 48:58].sum(1), counts[:, _LETTER].sum(1), counts[:, _SPACE].sum(1), counts[:, 10]], 1) / total
    shares = np.concatenate([shares, counts[:, _MARKS] / total], 1)
    step = np.searchsorted(_STEPS, shares, "left")
    feature = np.arange(shares.shape[1]) * 16 + step
    some = (step > 0) | (np.arange(shares.shape[1]) < 5)
    return np.stack([np.repeat(np.arange(n), some.sum(1)), feature[some]], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Shared weights and ascending thresholds, one for each grade from 1."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, values: list[bytes]) -> np.ndarray:
        """(texts, GRADES - 1): P(grade >= k) for k = 1, 2, .."""
        index, counts = features(values)
        score = np.bincount(np.repeat(np.arange(len(values)), counts), weights=self.weights[index], minlength=len(values))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def signals(held: np.ndarray, rated: np.ndarray, n: int, total: float, squares: float, min_docs: int = MIN_DOCS) -> np.ndarray:
    """Which features get a weight. held: documents that have each; rated: the sum of their grades; n, total, squares: number, sum and sum of squares of all grades."""
    mean = total / max(1, n)
    spread = max(1e-9, squares / max(1, n) - mean * mean)
    signal = np.abs(rated - held * mean) / np.sqrt(np.maximum(1e-9, held * spread))
    return (held >= min_docs) & (held < n) & (signal >= SIGNAL)


class Likelihood:
    """The cumulative-link likelihood of some rows and its slopes. Rows are lists of slots (numbers of weights) end to end."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray, grades: np.ndarray, size: int, decay: float):
        self.slots, self.row = slots.astype(np.int32), np.repeat(np.arange(len(grades), dtype=np.int32), counts)
        self.grades, self.size, self.decay = grades, size, decay

    def slopes(self, w: np.ndarray, first: float, gaps: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """Mean log likelihood less decay / 2 * w * w, and how it rises with the weights, the first threshold, and the logarithms of the gaps."""
        grades, n, at = self.grades, len(self.grades), np.arange(len(self.grades))
        thresholds = first + np.r_[0, np.cumsum(np.exp(gaps))]
        score = np.bincount(self.row, weights=w[self.slots], minlength=n)
        tail = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - thresholds), np.zeros((n, 1))], 1)
        high, low = tail[at, grades], tail[at, grades + 1]
        chance = np.maximum(1e-9, high - low)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = slope_high - slope_low
        by_cut = np.array([-slope_high[grades == k].sum() + slope_low[grades == k - 1].sum() for k in range(1, GRADES)])
        up = np.bincount(self.slots, weights=by_score[self.row], minlength=self.size) / n - self.decay * w
        gap_up = np.array([by_cut[k:].sum() for k in range(1, GRADES - 1)]) * np.exp(gaps) / n
        return np.log(chance).mean() - self.decay / 2 * (w * w).sum(), up, by_cut.sum() / n, gap_up


def fit(slots: np.ndarray, counts: np.ndarray, grades: np.ndarray, used: np.ndarray, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with weight decay, by full-batch Adam steps; the same rows give the same model.

    used: the features that get a weight; slots: the places in `used` of each row's features, row by row.
    """
    size = (1 << BITS) + _SHAPES
    if not len(grades):
        return OrdinalModel(np.zeros(size), np.full(GRADES - 1, -1e9))
    likelihood = Likelihood(slots, counts, grades, len(used), decay)
    share = (np.bincount(grades, minlength=GRADES) + 1) / (len(grades) + GRADES)
    below = np.cumsum(share)[:-1]
    # thresholds as a first cut and logarithms of the gaps, which keeps them ordered
    cut = np.log(below / (1 - below))
    w, first, gaps = np.zeros(len(used)), cut[0], np.log(np.maximum(1e-3, np.diff(cut)))
    state = [[np.zeros_like(np.asarray(p, float)), np.zeros_like(np.asarray(p, float))] for p in (w, first, gaps)]
    for t in range(1, rounds + 1):
        steps = []
        for (m, v), g in zip(state, likelihood.slopes(w, first, gaps)[1:], strict=True):
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * np.square(g)
            steps.append(rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
        w, first, gaps = w + steps[0], first + steps[1], gaps + steps[2]
    weights = np.zeros(size)
    weights[used] = w
    return OrdinalModel(weights, first + np.r_[0, np.cumsum(np.exp(gaps))])


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, pa.int32()))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """The model of a bounded, deterministic sample of labelled documents (doc_id, text; doc_id, quality, toxic).

    At most `sample` ids and 2 * `sample` rows of them, chosen by hashes. Rows of one id with the same
    features and grade are one row; an id with several texts or grades has a row for each, as far as the
    bound of rows goes. However often an id is repeated, the driver gets no more than these rows.

    Features are counted and chosen where the documents are; the driver gets, for each sampled
    row, only the numbers of its chosen features.
    """
    docs = texts(docs, id_col, text_col)
    rated = labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade")).filter("doc_id is not null and grade between 0 and 2")
    both = docs.join(rated.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    chosen = both.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = rated.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(2 * sample)
    rows = docs.join(F.broadcast(picked), "doc_id")
    size = (1 << BITS) + _SHAPES

    def featured(batches):
        for b in slices(batches, "text", 1 << 20):
            index, counts = features([t.encode() for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), _lists(counts, index)], ["doc_id", "grade", "features"])

    kind = dict(docs.dtypes)["doc_id"]
    every = written(rows.mapInArrow(featured, f"doc_id {kind}, grade int, features array<int>").withColumn("told", F.xxhash64("features")), "features")
    keys = ["doc_id", "grade", "told"]
    kept = every.select(keys).distinct().orderBy(F.xxhash64("doc_id", "told"), *keys).limit(2 * sample)
    found = written(every.join(F.broadcast(kept), keys, "left_semi").dropDuplicates(keys).drop("told"), "sampled")
    discarded(every)

    def counted(batches):
        held, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            index, counts = b.column("features").flatten().to_numpy(), np.diff(b.column("features").offsets.to_numpy())
            held += np.bincount(index, minlength=size)
            total += np.bincount(index, weights=np.repeat(b.column("grade").to_numpy(), counts), minlength=size).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at]), pa.array(total[at])], ["feature", "held", "rated"])

    n, total, squares = found.agg(F.count("*"), F.coalesce(F.sum("grade"), F.lit(0)), F.coalesce(F.sum(F.col("grade") * F.col("grade")), F.lit(0))).first()
    sums = found.select("grade", "features").mapInArrow(counted, "feature int, held long, rated long").groupBy("feature").agg(F.sum("held").alias("held"), F.sum("rated").alias("rated"))
    sums = sums.filter(F.col("held") >= MIN_DOCS).toArrow()  # a fixed number of features at most
    index = sums.column("feature").to_numpy()
    some = signals(sums.column("held").to_numpy(), sums.column("rated").to_numpy(), n, float(total), float(squares))
    used = np.sort(index[some])
    del sums, index, some

    def slotted(batches):
        slot = np.full(size, -1, np.int32)
        slot[used] = np.arange(len(used))
        for b in batches:
            counts = np.diff(b.column("features").offsets.to_numpy())
            mine = slot[b.column("features").flatten().to_numpy()]
            per_row = np.bincount(np.repeat(np.arange(len(counts)), counts)[mine >= 0], minlength=len(counts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), _lists(per_row, mine[mine >= 0])], ["doc_id", "grade", "slots"])

    got = found.mapInArrow(slotted, f"doc_id {kind}, grade int, slots array<int>").toArrow()
    discarded(found)
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), used)
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    lists = pa.concat_arrays(got.column("slots").chunks)
    model = fit(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), got.column("grade").to_numpy(), used)
    del got, lists
    trimmed()
    return model


def graded(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every document; with `carry`, also its text as it is and `rest`, a struct of those other columns of its row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), struct_of(carry or ()).alias("rest"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the corpus

    def run(batches):
        for b in slices(batches, "text", 1 << 18):
            tails = held.value.tails([(t or "").encode() for t in b.column("text").to_pylist()])
            found = [b.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep)]
            names = ["doc_id", "expected_grade", "tail_probability", "kept"]
            yield pa.RecordBatch.from_arrays([*found, b.column("text"), b.column("rest")] if carry else found, [*names, "text", "rest"] if carry else names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, tail_probability double, kept boolean"
    return docs.mapInArrow(run, with_rest(f"{schema}, text string", docs) if carry else schema)
