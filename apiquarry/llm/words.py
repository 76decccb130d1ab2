"""Hashes of words in their normal form."""

from __future__ import annotations

import numpy as np
import xxhash

#: Spellings a task remembers.
WORD_CACHE = 400_000
MARKS = ".,;:!?'\"()[]{}<>#$%&*+-/=@\\^_`|~"


class WordHashes(dict):
    """Spelling in a text → 64-bit hash of the lower-cased word without marks at its ends; 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip(MARKS)
        value = self[word] = xxhash.xxh3_64_intdigest(plain) if plain else 0
        return value

    def of(self, data: bytes) -> np.ndarray:
        """Hashes of all words of a text, in order."""
        parts = data.split()
        hashes = np.fromiter(map(self.__getitem__, parts), dtype=np.uint64, count=len(parts))
        return hashes[hashes != 0]
