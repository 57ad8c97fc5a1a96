"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding of a string is the only sequence of tokens in which every two neighbours, put together, encode to
themselves. So each prefix of a word has one last token, and the prefix before that token is shorter: the count of a
prefix is the count of that one, and one. The candidates for the last token are the vocabulary's strings that end there
(found by an automaton); a pair is tested once and remembered. Counts of all prefixes come from one pass over a word.

A text is cut before each run of ASCII white space, where the tokenizer's pattern always cuts, so the counts of a text's
prefixes are those of its chunks, one after another; a chunk is worked out once a task. Inside a chunk the pattern of a
prefix may differ from the whole chunk's in two places, both minded: a run of white space is one piece until something
follows it, and half of a contraction ("'r" of "'re") is two pieces. With the stored counts, questions about truncation and
budgets are array look-ups.

Defined cases: a null or empty text has no tokens; the special string counts as one token once it is whole, as the library
has it; a very long text is a block of its own; each row is counted alone, so repeated rows count each, a null doc_id
stays, and there are no ties; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import text as tx
from marketlens.llm.subwords import load
from marketlens.llm.tables import modest_batches, record_batch, tidy

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Pieces and pairs, and counts of chunks, that a task remembers; beyond it, it starts anew.
KEPT, KEPT_CHUNKS = 1 << 18, 1 << 19

#: A chunk of one word of Latin letters and what marks follow: its pieces are its groups.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
#: Contractions of the tokenizer's pattern that have a proper prefix of two characters (fixed values).
_CONTRACTIONS = ("'re", "'ve", "'ll")


def _white(c: str) -> bool:
    """White space of the tokenizer's pattern, which lacks the four separators of ASCII."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _ends(text: str) -> Iterable[int]:
    """Bytes up to the end of each character."""
    return range(1, len(text) + 1) if text.isascii() else accumulate(len(c.encode()) for c in text)


class PrefixCounter:
    """Token counts of prefixes under a byte-level vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import ahocorasick
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = load(vocabulary)
        self.model, self.cut = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # the alphabet's character of each byte: those of Latin-1 that print stand for themselves, others follow from 256 on
        whole = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {}
        for text in ("".join(map(chr, range(128))), "".join(map(chr, range(128, 0x800))), "".join(map(chr, range(0x800, 0x10000, 0x40))).encode("utf-8", "ignore").decode(), "".join(map(chr, range(0x10000, 0x110000, 0x1000)))):
            for byte, c in zip(text.encode(), whole.pre_tokenize_str(text)[0][0], strict=True):
                self.shown[byte] = c
        self.byte_of = {c: b for b, c in self.shown.items()}
        # a token that isn't its own encoding is no last token of anything
        self.ends = ahocorasick.Automaton()
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if all(c in self.byte_of for c in token) and [x.id for x in self.model.tokenize(token)] == [k]:
                self.ends.add_word(token, (k, len(token)))
        self.ends.make_automaton()
        self.token = self.tokenizer.id_to_token
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.numbers: dict[int, int] = {}

    def _test(self, a: int, b: int) -> bool:
        """Do two tokens, put together, encode to themselves?"""
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = [x.id for x in self.model.tokenize(self.token(a) + self.token(b))] == [a, b]
        return known

    def piece(self, shown: str) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes of one piece, given in the vocabulary's alphabet."""
        if (known := self.pieces.get(shown)) is not None:
            return known
        count, last, pair = [0] * (len(shown) + 1), [0] * (len(shown) + 1), self.pairs.get
        done = 0  # the prefix whose last token is found
        for end, (token, length) in self.ends.iter(shown):
            if end >= done:
                before = end + 1 - length
                if before:
                    apart = pair(last[before] << 32 | token)
                    if not apart and (apart is not None or not self._test(last[before], token)):
                        continue
                done = end + 1
                last[done], count[done] = token, count[before] + 1
        if len(self.pieces) >= KEPT:
            self.pieces.clear()
        self.pieces[shown] = count
        return count

    def _bytes(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.shown)

    def chunk(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... characters of a chunk, or of any text."""
        out: list[int] = []
        base = 0
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:  # a special string: until it is whole, it goes on with the plain text before it
                half = self.chunk_of_plain(before + part[:-1])
                out += [start + x for x in half[len(before) :]]
                base += 1
                out.append(base)
            else:
                before, start = part, base
                out += [base + x for x in self.chunk_of_plain(part)]
                base = out[-1] if part else base
        return np.array(out, dtype=np.int32)

    def chunk_of_plain(self, text: str) -> list[int]:
        out: list[int] = []
        base = at = 0
        pieces = [(shown, text[a:z]) for shown, (a, z) in self.cut(text)]
        while at < len(pieces):
            shown, raw = pieces[at]
            counts = self.piece(shown)
            got = [counts[e] for e in _ends(raw)]
            if raw in _CONTRACTIONS:
                got[1] = self.piece("'")[1] + self.piece(raw[1])[1]
            if _white(raw[-1]) and at + 1 < len(pieces) and _white((after := pieces[at + 1][1])[0]) and _white(after[-1]):
                # white space before white space: until something else follows, both are one run
                space = raw + after[0]
                more = self.piece(self._bytes(space))[-1]
                out += [base + x for x in got]
                base += counts[-1]
                shown, raw = pieces[at + 1]
                counts = self.piece(shown)
                got = [base + counts[e] for e in _ends(raw)]
                got[0] = base - self.piece(pieces[at][0])[-1] + more
                out += got
                base += counts[-1]
                at += 2
                continue
            out += [base + x for x in got]
            base += counts[-1]
            at += 1
        return out

    def number(self, text: str) -> int:
        """Tokens of a chunk: the count of its longest prefix."""
        plain = _PLAIN.fullmatch(text)
        if plain:
            word, marks = plain.groups()
            n = self.piece(self._bytes(word))[-1]
            return n + self.piece(marks)[-1] if marks else n
        parts = self.split.split(text) if self.split else [text]
        return len(parts) // 2 + sum(self.piece(shown)[-1] for part in parts[::2] for shown, _ in self.cut(part))

    def numbers_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each chunk of a block, worked out once for each different one."""
        hashes = tx.byte_prefix(data).spans(starts, ends)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.numbers) + keys.size > KEPT_CHUNKS:
            self.numbers.clear()
        known, raw, number = self.numbers, data.tobytes(), self.number
        out = np.empty(keys.size, np.int64)
        for k, (key, a, z) in enumerate(zip(keys.tolist(), starts[where].tolist(), ends[where].tolist(), strict=True)):
            n = known.get(key)
            if n is None:
                n = known[key] = number(raw[a:z].decode())
            out[k] = n
        return out[back]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of a block (ASCII white space and the word after it) and each document's first one.
    No cut is made after a character outside ASCII that may be white space, since a run of white space is one piece."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = tx.is_space(data)
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    # the last character before: of three bytes with these first ones, or of two bytes in the first block after ASCII
    at = np.flatnonzero(begin)
    one, two, three = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    odd = (one >= 0x80) & (np.isin(three, (0xE1, 0xE2, 0xE3)) | (two == 0xC2))
    odd |= (one >= 0x1C) & (one <= 0x1F)
    begin[at[odd]] = False
    full = offsets[1:] > offsets[:-1]
    begin[offsets[:-1][full]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], data.size), np.searchsorted(starts, offsets)


def _texts(docs: DataFrame) -> DataFrame:
    modest_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(vocabulary)
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(1), 1 << 21):
                starts, ends, bounds = chunks(data, offsets)
                sums = np.concatenate([[0], np.cumsum(counter.numbers_of(data, starts, ends))]) if starts.size else np.zeros(1, np.int64)
                n = sums[bounds[1:]] - sums[bounds[:-1]]
                yield record_batch(schema, b.column(0).slice(lo, hi - lo), np.diff(offsets), n, n > limit)

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ``counts``: the tokens of the text's prefixes of 0, 1, ... characters, each as if encoded alone. Write it
    once; ``tokens_of_prefix``, ``longest_prefix`` and ``first_over`` answer from it."""
    schema = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(vocabulary)
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(1)):
                starts, ends, bounds = chunks(data, offsets)
                raw, tables = data.tobytes(), []
                for d in range(hi - lo):
                    parts, base = [np.zeros(1, np.int32)], 0
                    for c in range(bounds[d], bounds[d + 1]):
                        parts.append(base + counter.chunk(raw[starts[c] : ends[c]].decode()))
                        base = int(parts[-1][-1])
                    tables.append(np.concatenate(parts))
                sizes = np.concatenate([[0], np.cumsum([x.size for x in tables])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(tables), pa.int32()))], schema=schema)

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, counts array<int>")


def tokens_of_prefix(characters: Column | int, counts: str = "counts") -> Column:
    """Tokens of the prefix of so many characters (of the whole text, where it is shorter)."""
    n = characters if isinstance(characters, Column) else F.lit(characters)
    return F.element_at(counts, F.least(n + 1, F.size(counts)))


def longest_prefix(budget: Column | int, counts: str = "counts") -> Column:
    """Characters of the longest prefix with at most so many tokens."""
    most = budget if isinstance(budget, Column) else F.lit(budget)
    return F.array_max(F.filter(F.transform(counts, lambda n, i: F.when(n <= most, i)), lambda i: i.isNotNull()))


def first_over(budget: Column | int, counts: str = "counts") -> Column:
    """Characters of the shortest prefix with more than so many tokens; null where there is none."""
    most = budget if isinstance(budget, Column) else F.lit(budget)
    return F.array_min(F.filter(F.transform(counts, lambda n, i: F.when(n > most, i)), lambda i: i.isNotNull()))
