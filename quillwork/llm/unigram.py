"""A unigram vocabulary made of a public SentencePiece file.

The file's pieces are kept as they are.  Its scores are ranks of a BPE, not
probabilities, so weights follow Zipf's law: a piece of score -r weighs
1 / (r + 2.7), normalised.  Pieces that a BPE never merges (scores at or below
-1e8) are left out, but for the blank itself, which weighs as the least piece, and
so do bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, int]
    log_prob: np.ndarray  # by id
    byte_id: tuple[int, ...]
    names: tuple[str, ...]
    longest: int

    @property
    def least(self) -> float:
        return float(self.log_prob[list(self.pieces.values())].min())


@cache
def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    names = tuple(model.id_to_piece(i) for i in ids)
    score = np.array([model.get_score(i) for i in ids])
    byte_id = tuple(i for i in ids if model.is_byte(i))
    use = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and score[i] > -1e8]
    weight = np.zeros(len(names))
    weight[use] = 1 / (2.7 - score[use])
    lone = [i for i in ids if names[i] == SPACE and i not in use]
    weight[[*byte_id, *lone]] = weight[use].min()
    use += lone
    with np.errstate(divide="ignore"):
        log_prob = np.log(weight / weight.sum())
    pieces = {names[i]: i for i in use}
    return Vocabulary(pieces, log_prob, byte_id, names, max(map(len, pieces)))


def public_pieces(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
