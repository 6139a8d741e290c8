"""Token ids of whole text columns under the public word-end BPE vocabulary.

Its pre-tokenizer never joins what white space separates, and no special token holds white space, so a
text's ids are those of its words in turn; a special token's name in a text gives its id. Each distinct word of a slice is tokenised once and kept in a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa

from grafloom.llm import _words

VOCABULARY, END, WINDOW = "word_bpe_49k.json", 1, 2048
#: Words kept between slices.
CACHE = 400_000
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: a printable Latin-1 byte stands for itself, the others follow from 256 on."""
    out, n = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or (161 <= b <= 255 and b != 173):
            out[b] = chr(b)
        else:
            out[b], n = chr(n), n + 1
    return out


class Tokens:
    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.part: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        # words' hashes in order, each one's slot, and where a slot's ids begin: arrays, as a dict of so many is ten times as large
        self.keys, self.slot, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def word(self, w: str) -> list[int]:
        """Ids of a text without ASCII white space; plain words go to the merge model directly."""
        m = _PLAIN.fullmatch(w.lower()) if w.isascii() or max(w) < "Ā" else None
        if m is None:
            return self.full.encode(w, add_special_tokens=False).ids
        out = self._model(m[1])
        if m[2]:
            if (p := self.part.get(m[2])) is None:
                p = self._model(m[2])
                if len(self.part) < 10_000:
                    self.part[m[2]] = p
            out = out + p
        return out

    def _model(self, w: str) -> list[int]:
        if not w.isascii():
            w = "".join(self.letters[b] for b in w.encode())
        return [t.id for t in self.full.model.tokenize(w)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END after each, and the offset of each text there."""
        raw, offs = _words.buffers(texts)
        start, end, row = _words.words(raw, offs)
        rows = len(offs) - 1
        h, where, back = np.unique(_words.hashes(raw, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._clear()
        at = np.searchsorted(self.keys, h)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == h[known]
        missing = np.flatnonzero(~known)
        data, sizes, new = raw.tobytes(), [], array("I")
        for s, e in zip(start[where[missing]].tolist(), end[where[missing]].tolist(), strict=True):
            got = self.word(data[s:e].decode("utf-8", "replace"))
            new.extend(got)
            sizes.append(len(got))
        slots = np.empty(len(h), np.int64)
        slots[known] = self.slot[at[known]]
        slots[missing] = len(self.begin) - 1 + np.arange(len(missing))
        self.keys, self.slot = np.insert(self.keys, at[missing], h[missing]), np.insert(self.slot, at[missing], slots[missing])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes, dtype=np.int64)])
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), 2 * len(new)), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        begin = self.begin
        slot = slots[back] if len(h) else np.zeros(0, np.int64)
        size = begin[slot + 1] - begin[slot]
        per = np.bincount(row, size, minlength=rows).astype(np.int64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[slot], size)
        ends = np.cumsum(per)
        out = np.insert(self.flat[at], ends, END) if rows else np.zeros(0, np.uint32)
        return out.astype("<u4"), np.concatenate([[0], np.cumsum(per + 1)])


_OWN: dict[str | None, Tokens] = {}


def shared(path: str | None = None) -> Tokens:
    """This process's tokenizer, whose cache later tasks of the same worker use too."""
    if path not in _OWN:
        _OWN[path] = Tokens(path)
    return _OWN[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
