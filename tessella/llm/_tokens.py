"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces.

Byte-level BPE with the usual pattern never lets a token cross the point
before a single space. So a text falls into pieces at its spaces, each encoded
by the library once and remembered. Texts with two spaces in a row or with a
special token's string are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from tessella.llm._text import KEPT, trim

#: Pieces that a worker remembers; beyond that, new ones are encoded where they occur.
MEMORY_PIECES = 1_000_000
#: Pieces that are encoded in one call.
_TOGETHER = 50


class Encoder:
    """``encode(texts)``: for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pieces: int = MEMORY_PIECES):
        self.pieces = pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.splits = self._splits()
        self.memory: dict[str, bytes] = {}

    def _splits(self) -> bool:
        """Whether the file describes a byte-level model for which pieces at spaces are independent."""
        probe = "One, two\n three  four été's 12 3 \n x"
        cut = probe.replace(" ", "\0 ").split("\0")
        return "  " not in probe and self._whole(probe) == b"".join(map(self._whole, cut)) and bool(self.opens.any())

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        """Ids of each word with a space before it."""
        plain = [w for w in words if w and not w.isspace()]
        for k in range(0, len(plain), _TOGETHER):
            group = plain[k : k + _TOGETHER]
            ids = np.asarray(self.tokenizer.encode(" " + " ".join(group), add_special_tokens=False).ids, "<u4")
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(group) and first[0] == 0:
                data, edges = ids.tobytes(), [*(first * 4).tolist(), 4 * len(ids)]
                into.update((w, data[i:j]) for w, i, j in zip(group, edges, edges[1:], strict=False))
            else:
                into.update((w, self._whole(" " + w)) for w in group)
        into.update((w, self._whole(" " + w)) for w in words if not w or w.isspace())

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.memory.get
        cuts: list[tuple[str, list[str], list[bytes | None]] | None] = []
        new: set[str] = set()
        for text in texts:
            if not self.splits or "  " in text or any(s in text for s in self.special):
                cuts.append(None)
                continue
            head, *words = text.split(" ")
            found = list(map(known, words))
            if None in found:
                new.update(w for w, f in zip(words, found, strict=True) if f is None)
            cuts.append((head, words, found))
        fresh: dict[str, bytes] = {}
        self._learn(list(new), fresh)
        if len(self.memory) + len(fresh) <= self.pieces:
            self.memory.update(fresh)
        out = []
        for text, cut in zip(texts, cuts, strict=True):
            if cut is None:
                out.append(self._whole(text))
                continue
            head, words, found = cut
            if None in found:
                found = [fresh[w] if f is None else f for w, f in zip(words, found, strict=True)]
            out.append((self._whole(head) if head else b"") + b"".join(found))
        return out


def encoder(path: str, pieces: int = MEMORY_PIECES) -> Encoder:
    """This worker's encoder for a tokenizer file, which remembers up to ``pieces``."""
    if (path, pieces) not in KEPT:
        KEPT.clear()
        KEPT[path, pieces] = Encoder(path, pieces)
    return KEPT[path, pieces]


def pieces_of(column, limit: int = 1 << 20):
    """``(first row, texts)`` of about ``limit`` characters each; a null is an empty text."""
    texts, first, size = [], 0, 0
    for r, text in enumerate(column):
        text = text.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield first, texts
            texts, first, size = [], r + 1, 0
    if texts:
        yield first, texts
    trim()
