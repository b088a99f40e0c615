"""Token ids of many texts with the ``tokenizers`` library and a cache of words.

The pre-tokenizers used here cut at blanks, so a text's ids are the ids of its
blank-separated parts, one after the other. Each part is encoded once per Python
worker and then looked up. The cache has two generations of ``CACHE_WORDS / 2`` parts:
a full one becomes the old one, parts found there move back, and what no text has
used since is forgotten. Whether a tokenizer's file allows this is tried on a probe
text with every kind of blank and stop; others encode whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

CACHE_WORDS = 400_000
# Words encoded together; one group's tokens are held at a time.
GROUP, ODD_GROUP = 5_000, 500

# Blanks, stops, digits, marks and letters side by side: ids of parts must add up to ids of the whole.
PROBE = "A b.  c, d.e 1.5 x.\ny, (z) über naïve 数据. it's  \n\n.,; Ab\tc end."

# Stands between parts that are not of letters only; one token in the tokenizers used here.
DIVIDER = "which"

# A full stop or comma after a letter or digit and before a blank is a token of its own.
_STOP = re.compile(r"[.,](?=[ \n])(?<=[^\W_][.,])")


class WordEncoder:
    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        ends = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        divider = self._ids([DIVIDER])[0]
        self.divider = int(divider[0]) if len(divider) == 1 else None
        self.by_parts = self._by_parts([PROBE])[0] == self._whole([PROBE])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        cache = self.cache
        missing = [w for w in parts if w not in cache]
        if len(cache) + len(missing) > CACHE_WORDS // 2:
            self.old, self.cache = cache, {}
            missing = list(parts)
        new = []
        for w in missing:
            known = self.old.get(w)
            if known is None:
                new.append(w)
            else:
                self.cache[w] = known
        # Words of letters only are encoded as one text; each ends with its one end-of-word token.
        plain = [w for w in new if w.isalpha()]
        for at in range(0, len(plain), GROUP):
            group = plain[at : at + GROUP]
            ids = self._ids([" ".join(group)])[0]
            self._store(group, ids, np.flatnonzero(self.ends[ids]) + 1)
        # Others stand between dividers; a part that holds the divider itself shows in their number.
        odd = [w for w in new if not w.isalpha()]
        if self.divider is None:
            self._one_by_one(odd)
            return
        for at in range(0, len(odd), ODD_GROUP):
            group = odd[at : at + ODD_GROUP]
            ids = self._ids([f" {DIVIDER} ".join([*group, ""]).rstrip(" ")])[0]
            self._store(group, ids, np.flatnonzero(ids == self.divider) + 1, 1)

    def _store(self, words: list[str], ids: np.ndarray, stop: np.ndarray, tail: int = 0) -> None:
        """Keep the ids of each word, which ends at its ``stop`` less ``tail`` ids."""
        if len(stop) != len(words):
            self._one_by_one(words)
            return
        raw, last = ids.tobytes(), 0
        for word, end in zip(words, (stop * 4).tolist(), strict=True):
            self.cache[word] = raw[last : end - 4 * tail]
            last = end

    def _one_by_one(self, words: list[str]) -> None:
        for word, ids in zip(words, self._ids(words), strict=True):
            self.cache[word] = ids.tobytes()

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        parts = [_STOP.sub(r" \g<0>", t).replace("\n", " ").split(" ") for t in texts]
        self._learn(set().union(*parts))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self._ids(texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return self._by_parts(texts) if self.by_parts else self._whole(texts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task.

    Spark runs a worker on each core; the tokenizer's own threads would each keep freed memory besides.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)
