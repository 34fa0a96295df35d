"""Token ids of whole texts by the tokenizers library, one distinct word at a time."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: The white space of Unicode's White_Space property, as the tokenizers' patterns see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters that every normaliser here leaves alone but for their case; texts of these, ASCII and line breaks are simple.
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
SIMPLE = re.compile(f"[\\t\\n\\r -~{LETTERS}]*")
#: The word patterns of the two vocabularies' files, for simple texts.
DROPS_SPACE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\t\\n\\r {LETTERS}0-9]+")
KEEPS_SPACE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\t\\n\\r {LETTERS}0-9]+|[\\t\\n\\r ]+(?![^\\t\\n\\r ])|[\\t\\n\\r ]+")


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if visible in Latin-1, else the next free one."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memory:
    """What a function gives for each distinct word, for the ``limit`` to 2 x ``limit`` words used last."""

    def __init__(self, function, limit: int):
        self.function, self.limit, self.now, self.before = function, limit, {}, {}

    def __call__(self, words: list[str]) -> map:
        new = set(words).difference(self.now)
        if new:
            if len(self.now) > self.limit:
                self.before, self.now = self.now, {}
                new = set(words)
            now, before = self.now, self.before
            for word in new:
                found = before.get(word)
                now[word] = self.function(word) if found is None else found
        return map(self.now.__getitem__, words)


class Encoder:
    """Ids of whole texts, equal to the library's.

    A simple text is cut by the vocabulary's own pattern, and each distinct part goes to the library's merges once. Any other text is cut
    where its tokenizer always cuts, at blanks that the vocabulary drops (``keeps_space`` false) or before each run of white
    space, and each distinct piece goes through the library's whole chain once. A text that holds the string of an added
    token, in any case, goes through the library whole, which decides what it is.
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges, self.keeps_space = self.whole.model, keeps_space
        added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.adds = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE).search
        # what all of them begin with besides letters is looked for first: most texts do not hold it
        self.openings = {re.match(r"[\W_]*", x)[0] for x in added}
        symbols = byte_symbols()
        self.symbols = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(256)}
        self.parts, self.pieces = Memory(self._part, limit), Memory(self._piece, limit // 4)
        self.split = (KEEPS_SPACE if keeps_space else DROPS_SPACE).findall
        self.cut = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall if keeps_space else lambda text: text.split(" ")

    def _part(self, part: str) -> tuple[int, ...]:
        symbols = part if part.isascii() and part.isalnum() else part.translate(self.symbols)
        return tuple([t.id for t in self.merges.tokenize(symbols)])

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.whole.encode(piece, add_special_tokens=False).ids)

    def __call__(self, text: str | None, *end: int) -> np.ndarray:
        """The ids of one text (null: empty), and the given end ids."""
        if not text:
            ids = ()
        elif any(x in text for x in self.openings) and self.adds(text):
            ids = (self.whole.encode(text, add_special_tokens=False).ids,)
        elif SIMPLE.fullmatch(text):
            ids = self.parts(self.split(text if self.keeps_space else text.lower()))
        else:
            ids = self.pieces(self.cut(text))
        return np.fromiter(chain(chain.from_iterable(ids), end), np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One per Python worker, so that later tasks find its words."""
    return Encoder(path, keeps_space)
