"""Subword ids of whole blocks of text, one tokenizer call for each piece of a word that a task has not met.

The tokenizers used here never join what ASCII white space separates, so a text's ids are those of its words in
order. Where the tokenizer's own pattern cuts at letters, digits and marks, words of Latin letters, digits and marks are
cut so by their bytes, all words of a block at once, and a piece, which recurs in many words, goes to the tokenizer's
model; any other word goes whole through the whole tokenizer. A task keeps the ids of the pieces and words it has met,
up to a bound, by 64-bit hash.
"""

from __future__ import annotations

import json

import numpy as np

from marketlens.llm import text as tx

#: Pieces and words whose ids a task keeps; beyond it the store starts anew.
KEPT_WORDS = 1 << 18

#: What the tokenizer cuts words by.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# What a byte of a word is: a letter, a digit, a mark, or something that only the whole tokenizer knows: an apostrophe
# (endings like 's), "<" (special tokens) and whatever is no ASCII and no letter of U+00C0 to U+023F. Those letters have
# two bytes, the first of C3 to C8; their normal form and lower case depend on nothing around them.
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[0x27, 0x3C]] = _ODD
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER
#: Two bytes that are no such letter: the signs of times and division, and the capital I with a dot.
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))

# How a byte is shown to the model: printable ones as themselves, the others as the characters from 256 on.
_SHOWN = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def load(vocabulary: str):
    """A tokenizer of the public files; imported here, in the task that needs it."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


class Encoder:
    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """An encoder for one task; what it keeps goes with the task."""
        return cls(load(vocabulary))

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        said = json.loads(tokenizer.to_str())
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        self.cuts = known and steps[0]["pattern"].get("Regex") == _PATTERN
        self._clear()

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes (of cut words in lower case as far as they are ASCII), starts and ends of the pieces, which of them are
        whole words for the whole tokenizer, and the index of each document's first piece (n + 1 values)."""
        starts, ends, bounds = tx.word_spans(data, offsets)
        if not self.cuts or not starts.size:
            return data, starts, ends, np.ones(starts.size, bool), bounds
        kind = _KIND[data]
        for a, b in _NO_LETTERS:
            kind[np.flatnonzero((data[:-1] == a) & (data[1:] == b))] = _ODD
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])  # white space counts, too, but lies in no word
        whole = odd[ends] > odd[starts]
        # 1 within a word that is cut, 0 elsewhere
        delta = np.zeros(data.size + 1, np.int8)
        delta[starts[~whole]] += 1
        delta[ends[~whole]] -= 1
        cut = np.cumsum(delta[:-1], dtype=np.int8).view(bool)
        begin = np.zeros(data.size, bool)
        begin[1:] = cut[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        begin[starts] = True
        first = np.flatnonzero(begin)
        word = np.cumsum(np.bincount(np.searchsorted(first, starts), minlength=first.size)) - 1
        last = np.minimum(np.append(first[1:], data.size), ends[word])
        return np.where(cut, tx.lower(data), data), first, last, whole[word], np.searchsorted(first, offsets)

    def _known_ids(self, texts: list[str], whole: list[bool]) -> list:
        """Ids of each text: a piece, or a whole word."""
        if not self.cuts:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut, encode = self.model.tokenize, self.tokenizer.encode
        shown = lambda x: x if x.isascii() else x.lower().encode().decode("latin-1").translate(_SHOWN)
        return [encode(x, add_special_tokens=False).ids if w else [t.id for t in cut(shown(x))] for x, w in zip(texts, whole, strict=True)]

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = self._known_ids(texts, whole.tolist())
        count = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for x in got for i in x), np.uint32, int(count.sum()))
        first = self.store.size + np.cumsum(count) - count
        self.store = np.concatenate([self.store, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's documents one after another, and the index of each document's first (n + 1 values)."""
        data, starts, ends, whole, bounds = self._pieces(data, offsets)
        if not starts.size:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = tx.byte_prefix(data).spans(starts, ends)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.keys.size + keys.size > KEPT_WORDS and self.keys.size:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(keys.size, bool)
        inside = at < self.keys.size
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(data, keys[new], starts[where[new]], ends[where[new]], whole[where[new]])
            at = np.searchsorted(self.keys, keys)
        first, count = self.first[at][back], self.count[at][back]
        total = np.cumsum(count)
        take = np.arange(int(total[-1])) - np.repeat(total - count, count) + np.repeat(first, count)
        return self.store[take], np.concatenate([[0], total])[bounds]
