"""Ids of words that are cut by their bytes equal those of the whole tokenizer."""

import random

import pyarrow as pa

from marketlens.llm import packing, subwords
from marketlens.llm import text as tx


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    signs = [*"abzAZ019.,;:!?-'\"<>|# \t\n\r\x0b\x0c", *"éÉñ×÷İıßſɏȿǄǅƻǀȺȾ́中١½²ªµ’  Σς😀\x00\x7f\u0085KÅ", "<|endoftext|>", "'s", "'RE"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)] + ["", None, "'", "é", "×"]
    encoder = subwords.Encoder.of(packing.VOCABULARY)
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for lo, hi, data, offsets in tx.blocks(pa.array(texts, pa.string())):
        ids, bounds = encoder.ids(data, offsets)
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)] == want[lo:hi]


def test_words_share_their_pieces():
    stems = [f"st{a}ne" for a in "aeiou"]
    text = " ".join(w + m for s in stems for w in (s, s.upper(), s.title()) for m in (".", ",", "!", "", "7"))
    encoder = subwords.Encoder.of(packing.VOCABULARY)
    data, offsets = tx.column_bytes(pa.array([text]))
    encoder.ids(data, offsets)
    assert encoder.keys.size == len(stems) + 4  # 75 words, but so many pieces
