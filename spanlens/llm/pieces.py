"""The pieces of a sentencepiece BPE vocabulary, pre-token by pre-token.

No piece of such a vocabulary goes on after a word's end: the space mark stands only at the start of a piece, and a line
break is in none.  So the pieces of a text are those of its pre-tokens, each a run of space marks with what follows up
to the next mark or line break, or a line break.  ``Vocabulary`` checks this when it opens a model.
"""

import re
from itertools import chain

import numpy as np
import sentencepiece

from .common import remembered

MARK = "▁"
MODEL = "piece_bpe_32k.model"
_PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_open = remembered()
#: Pre-tokens that ``packed`` gives to the model as one text.
TOGETHER = 16


def model_path(name: str = MODEL) -> str:
    """Where the public vocabulary is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    return _PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


class Vocabulary:
    """One model, opened once in each Python worker."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = self.model.id_to_piece(list(range(size)))
        if any("\n" in n or MARK in n.lstrip(MARK) for n in names):
            raise ValueError(f"{path}: pieces go on after a word's end")
        self.byte = [self.model.is_byte(i) for i in range(size)]
        self.line_break = self.model.encode("\n")[-1]

    @staticmethod
    def at(path: str) -> "Vocabulary":
        if path not in _open:
            _open[path] = Vocabulary(path)
        return _open[path]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each pre-token.  A line break before it keeps the model's own leading mark away from it; those
        two pieces go."""
        return [ids[2:] for ids in self.model.encode([f"\n{w}" for w in words], num_threads=1)]

    def packed(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, four bytes each, as ``encode`` gives them.

        The model gets ``TOGETHER`` of them as one text, a line break before each: no piece goes on over one, and where it
        is a byte no other character gives its id.  Where line breaks don't come out as they went in, each goes alone."""
        plain = [w for w in words if "\n" not in w] if self.byte[self.line_break] else []
        lines = ["\n" + "\n".join(plain[at:at + TOGETHER]) for at in range(0, len(plain), TOGETHER)]
        each = self.model.encode(lines, num_threads=1)
        flat = np.fromiter(chain.from_iterable(each), np.int32)
        size = np.fromiter(map(len, each), np.int64, len(each))
        # The first id of each text is the model's own leading mark.
        flat = np.delete(flat, np.cumsum(size) - size)
        breaks = np.flatnonzero(flat == self.line_break)
        if not plain or len(breaks) != len(plain):
            return [np.array(ids, np.int32).tobytes() for ids in self.encode(words)]
        raw, ends = flat.tobytes(), [*(4 * breaks[1:]).tolist(), 4 * len(flat)]
        found = [raw[start:end] for start, end in zip((4 * breaks + 4).tolist(), ends)]
        if len(plain) == len(words):
            return found
        rest, alone = iter(found), {w: np.array(self.encode([w])[0], np.int32).tobytes() for w in words if "\n" in w}
        return [alone[w] if w in alone else next(rest) for w in words]
