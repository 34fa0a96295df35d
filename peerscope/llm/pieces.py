"""Pieces of a SentencePiece model, shared by sampling and counting."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

MARK = "▁"  # fixed value: how pieces write a blank


@dataclass(frozen=True)
class Pieces:
    texts: list[str]  # by id
    ids: dict[str, int]  # ordinary pieces
    byte_ids: list[int]  # by byte
    log_p: dict[str, float]
    byte_log_p: float


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    """Read a model with byte fallback.

    A unigram model's scores are log-probabilities. A merge model's scores are minus the merge's rank; there the
    probability of a piece is taken by Zipf's law, 1 / (rank + 2), over all pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte fallback")
    if any(MARK in texts[i].lstrip(MARK) for i in plain):
        raise ValueError("pieces that reach over the start of a word are not supported")
    scores = {i: model.get_score(i) for i in plain}
    if all(s == int(s) for s in scores.values()):
        weights = {i: 1 / (min(-s, n) + 2) for i, s in scores.items()}
    else:
        weights = {i: math.exp(s) for i, s in scores.items()}
    total = sum(weights.values())
    log_p = {texts[i]: math.log(w / total) for i, w in weights.items()}
    return Pieces(texts, {texts[i]: i for i in plain}, byte_ids, log_p, min(log_p.values()))
