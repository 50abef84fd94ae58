"""Token ids of whole texts by a public tokenizer, through a table of the words seen so far."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import textkit

#: Words that a worker keeps; beyond it the table starts anew, so that memory stays bounded.
KEPT_WORDS = 700_000
#: Bytes of text for one look at the table.
LOOK_BYTES = 1 << 20
#: A word that no text holds and that stands between the words asked of the tokenizer.
MARK = "\x01"

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[x for x in range(33, 127) if not chr(x).isalpha() and chr(x) not in "'|"]] = 2
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    """One more than the largest id of the tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def letter_edges(b: np.ndarray) -> np.ndarray:
    """Places between a letter (ASCII, or Latin-1 before the edge) and an ASCII sign or digit: there the tokenizer's own words end too.

    No edge is beside an apostrophe or a bar, which may begin a contraction or belong to a special token.
    """
    kind = _KIND[b]
    letter = kind == 1
    letter[1:] |= (b[:-1] == 0xC3) & _LATIN[b[1:]]
    out = np.zeros(len(b), bool)
    out[1:] = (letter[:-1] & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1))
    return out


class WordCoder:
    """Ids of parts of words, looked up by a 64-bit hash, checked by another one, and asked of the tokenizer once.

    The tokenizer drops white space, lower-cases, and no id of it spans white space or an edge of ``letter_edges``, so the ids of a text
    are those of its parts in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts``, one after another, and how many each has."""
        ids, sizes = [], []
        for lo in range(0, len(texts), 4096):
            some = texts[lo : lo + 4096]
            got = np.array(self.tokenizer.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.append(np.flatnonzero(got == self.mark[0]), len(got)) if len(self.mark) == 1 else np.zeros(0, np.int64)
            if len(ends) != len(some):  # a text holds the mark: each alone
                each = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
                ids += [np.array(x, np.uint32) for x in each]
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            else:
                ids.append(np.delete(got, ends[:-1]))
                sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        """Add words with sorted new ``keys``."""
        ids, sizes = self.ask(texts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.checks = np.insert(self.checks, at, checks)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used += len(ids)

    def whole(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents and how many each has, by the tokenizer alone."""
        each = [self.tokenizer.encode(data[a:z].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.fromiter((i for e in each for i in e), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents ``data[offs[i]:offs[i + 1]]`` and how many each has."""
        w = textkit.words(data, offs, table=None, cuts=letter_edges)
        b = data[offs[0] : offs[-1]]
        read = textkit.LOWER[b]
        bars = np.flatnonzero(b == 124)
        for i in np.unique(np.searchsorted(w.start, bars, "right") - 1).tolist():  # special tokens are told by their case
            read[w.start[i] : w.end[i]] = b[w.start[i] : w.end[i]]
        every, check = (textkit.hashes(read, w.start, w.end, seed) for seed in (0, 1))
        keys, first, back = np.unique(every, return_index=True, return_inverse=True)
        checks = check[first]
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
            if not len(new):
                break
            if len(self.keys) + len(new) > KEPT_WORDS and len(self.keys):
                self.clear()
                new = np.arange(len(keys))
            raw = b.tobytes()
            self.learn(keys[new], checks[new], [raw[a:z].decode("utf-8", "replace") for a, z in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
        if len(keys) and ((self.checks[place] != checks).any() or (checks[back] != check).any()):  # two words share a key: ask for all
            return self.whole(data, offs)
        sizes = self.sizes[place][back]
        ids = self.ids[ragged(self.starts[place][back], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[w.first])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode_documents(column: pa.Array, path: str, closing: int):
    """For slices of a text column: (first row, last row, ids with ``closing`` after each document, ids per document with it)."""
    data, offs = textkit.text_buffers(column)
    for lo, hi in textkit.slices(offs, LOOK_BYTES):
        ids, sizes = coder(path).encode(data, offs[lo : hi + 1])
        ends = np.cumsum(sizes)
        yield lo, hi, np.insert(ids, ends, np.uint32(closing)), sizes + 1
