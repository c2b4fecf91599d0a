"""A tokenizer that encodes each distinct word once per Python worker.

``word_bpe_49k`` brings a text to NFC, lowers it, drops white space and never merges across it, nor across the border of
a run of letters or digits and the punctuation after it. So a text's ids are those of its words in turn; words are
looked up in a bounded cache. Texts for which these steps can't be swapped safely are cut at white space only.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Control characters that Python's split takes as white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Letters, then ASCII symbols.
_PARTS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")


class WordTokenizer:
    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.most, self.cache = most, {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, missing: list[str]) -> None:
        """Put words into the cache: letters with symbols after them are encoded apart, runs of letters together."""
        parts, plain = {}, {}
        for w in missing:
            found = _PARTS.fullmatch(w)
            if not found:
                self.cache[w] = self._ids(w).tobytes()
                continue
            core, tail = found.groups()
            if tail:
                parts[w] = core, tail
                if tail not in self.cache:
                    self.cache[tail] = self._ids(tail).tobytes()
            if core not in self.cache:
                plain[core] = None
        plain, wide = list(plain), self.kind.itemsize
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, stops = ids.tobytes(), (wide * ends).tolist()
                self.cache.update(zip(some, [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
            else:  # a letter whose lower case isn't one letter
                self.cache.update((w, self._ids(w).tobytes()) for w in some)
        for w, (core, tail) in parts.items():
            self.cache[w] = self.cache[core] + self.cache[tail]

    def _words(self, text: str) -> list[str]:
        if "<|" in text or not text.isascii() and ("Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text)):
            return text.split()
        return text.lower().split()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids, as two or four bytes each by the vocabulary's size."""
        if not text:
            return np.empty(0, self.kind)
        if _ODD.search(text):
            return self._ids(text)
        found = self._words(text)
        ids = list(map(self.cache.get, found))
        if None in ids:
            if len(self.cache) > self.most:
                self.cache.clear()
                ids = [None] * len(found)
            self._learn(list({w for w, x in zip(found, ids, strict=True) if x is None}))
            ids = map(self.cache.__getitem__, found)
        return np.frombuffer(b"".join(ids), self.kind)

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def word_tokenizer(name: str = "word_bpe_49k.json", path: str | None = None) -> WordTokenizer:
    """One per Python worker. ``path`` overrides the place of a public vocabulary file."""
    return WordTokenizer(path or public_path(name))
