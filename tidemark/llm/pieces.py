"""A vocabulary of text pieces under a unigram law, shared by token counts and sampled segmentation.

The vocabulary file is a parameter and is read where it is used; nothing is trained. It
orders its pieces by how common they are but gives no probabilities, so a piece of rank r
gets a probability in proportion to 1 / (r + SHIFT). Characters that no piece covers
fall back to their UTF-8 bytes.

A text is cut into pre-tokens: a run of other characters with the space before it, if any;
a lone space; a line end. A space is written as the mark that the vocabulary uses. The
mark itself, where a text holds it, goes through byte pieces, so that decoding is exact.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT = 10
MARK = "▁"
_ALIAS = "\U0010fffe"  # stands for a mark that is part of a text; no piece holds it
PRETOKEN = re.compile(r" ?[^ \n]+| |\n")


def pretokens(text: str) -> list[str]:
    if MARK in text:
        text = text.replace(MARK, _ALIAS)
    return PRETOKEN.findall(text)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_ids, text_ids = [0] * 256, []
        for k in range(self.size):
            if model.is_byte(k):
                self.byte_ids[int(model.id_to_piece(k)[3:5], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k)):
                text_ids.append(k)
        total = sum(1 / (r + SHIFT) for r in range(len(text_ids) + 256))
        self.byte_score = -math.log(len(text_ids) + 255 + SHIFT) - math.log(total)
        #: piece (a space where the vocabulary has its mark) -> (id, natural logarithm of its probability)
        self.pieces = {model.id_to_piece(k).replace(MARK, " "): (k, -math.log(r + SHIFT) - math.log(total)) for r, k in enumerate(text_ids)}
        self.spelled = [b""] * self.size
        for piece, (k, _) in self.pieces.items():
            self.spelled[k] = piece.encode()
        for b, k in enumerate(self.byte_ids):
            self.spelled[k] = bytes([b])

    def fallback(self, letter: str) -> bytes:
        """The bytes that a character without pieces becomes."""
        return (MARK if letter == _ALIAS else letter).encode("utf-8", "surrogatepass")

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; ids without text (control pieces) are empty."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")

    @property
    def tree(self) -> dict:
        """Pieces as nested dicts; under "" a node's (id, score)."""
        root: dict = {}
        for piece, value in self.pieces.items():
            node = root
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = value
        return root

    def transitions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same tree as arrays: sorted keys (state << 21 | letter), the state each leads to, and each state's id (-1: none) and score."""
        keys, to, ids, scores, state = [], [], [-1], [0.0], {"": 0}
        for piece in sorted(self.pieces):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in state:
                    state[piece[:k]] = len(ids)
                    keys.append((state[piece[: k - 1]] << 21) | ord(piece[k - 1]))
                    to.append(len(ids))
                    ids.append(-1)
                    scores.append(0.0)
            ids[state[piece]], scores[state[piece]] = self.pieces[piece]
        order = np.argsort(keys)
        return np.array(keys, np.int64)[order], np.array(to, np.int64)[order], np.array(ids, np.int64), np.array(scores)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
