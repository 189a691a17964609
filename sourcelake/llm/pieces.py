"""The pieces of a SentencePiece BPE model, read once in each worker."""

from __future__ import annotations

import functools
import re

import sentencepiece

#: Between these units no piece and no merge reaches: a run of spaces with the word after it, a line end, spaces alone.
UNIT = re.compile(r" *[^ \n]+|\n| +")
#: The same where the model has pieces with a line end.
UNIT_WITH_LINES = re.compile(r" *[^ ]+| +")


class Pieces:
    """Pieces in raw form: the model's space mark is a space again."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.size = size
        self.byte_id = [-1] * 256
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(size):
            if sp.is_byte(i):
                self.byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = sp.id_to_piece(i).replace("▁", " ")
                self.id[raw], self.score[raw] = i, sp.get_score(i)
        if min(self.byte_id) < 0:
            raise ValueError("the model has no byte pieces")
        if any(" " in raw.lstrip(" ") for raw in self.id):
            raise ValueError("the model has pieces that go on behind a space")
        self.longest = max(map(len, self.id))
        self.unit = UNIT_WITH_LINES if any("\n" in raw for raw in self.id) else UNIT
        probe = "a  b\n ( ﬁ"
        if sp.decode(sp.encode(probe)) != probe or sp.encode("a") != sp.encode_as_ids("a"):
            raise ValueError("the model changes texts before it splits them")


@functools.lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)
