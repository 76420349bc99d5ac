"""Operator 3: token counts by trie-shared dynamic programming.

The distinct pre-tokens of many documents share prefixes. They are walked as one trie (in
sorted order, which visits its nodes depth first): each node keeps the best unigram score
of any segmentation of the prefix that leads to it, with its number of tokens, so a
shared prefix is scored once. The count at a pre-token's terminal node is stored, and a
document's count is the sum over its pre-tokens. Of equally good segmentations the one
with fewer tokens counts.

Every whole text is counted. Nulls: a null or empty text has no tokens; a null id stays.
Repeated rows are counted each. Other columns are dropped. Memory holds the counts of at
most CACHED pre-tokens at a time; what is forgotten is computed again.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slices, texts
from tidemark.llm.pieces import DEFAULT_MODEL, Vocabulary, pretokens, vocabulary

CACHED = 400_000


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def terminal_counts(words: Iterable[str], vocab: Vocabulary, tree: dict) -> dict[str, int]:
    """Tokens in the best segmentation of each distinct pre-token."""
    out: dict[str, int] = {}
    #: by depth: best score, its tokens, and the pieces that are still open there as (tree node, score and tokens before)
    best, tokens, still = [0.0], [0], [[]]
    before = ""
    for word in sorted(words):
        depth = shared_prefix(before, word)
        del best[depth + 1 :], tokens[depth + 1 :], still[depth + 1 :]
        for letter in word[depth:]:
            top, fewest, open_pieces = None, 0, []
            for node, score, used in (*still[-1], (tree, best[-1], tokens[-1])):
                if (child := node.get(letter)) is not None:
                    open_pieces.append((child, score, used))
                    if (end := child.get("")) is not None:
                        total = score + end[1]
                        if top is None or total > top or (total == top and used + 1 < fewest):
                            top, fewest = total, used + 1
            if letter not in vocab.pieces:
                n = len(vocab.fallback(letter))
                total = best[-1] + n * vocab.byte_score
                if top is None or total > top:
                    top, fewest = total, tokens[-1] + n
            best.append(top)
            tokens.append(fewest)
            still.append(open_pieces)
        out[word] = tokens[len(word)]
        before = word
    return out


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every document."""
    docs = texts(docs, id_col, text_col)

    def run(batches):
        vocab = vocabulary(model)
        tree, known = vocab.tree, {}
        for b in slices(batches, "text", 4 << 20):
            cut = [pretokens(t) for t in b.column("text").to_pylist()]
            fresh = {w for words in cut for w in words if w not in known}
            if len(known) + len(fresh) > CACHED:
                known, fresh = {}, {w for words in cut for w in words}
            known.update(terminal_counts(fresh, vocab, tree))
            counts = [sum(map(known.__getitem__, words)) for words in cut]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in cut], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_pretokens long, n_tokens long")
