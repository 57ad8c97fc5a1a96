"""Token counts of prefixes against the tokenizer itself."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import prefix_tokens, subwords

DOCS = "doc_id long, text string, n_tokens long, counts string"
#: Pieces that meet the odd places of the pattern: white space of all kinds, contractions, special strings, marks.
PARTS = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "'re", "'ll", "'v", "'s", "é", "ß", "漢", "🙂", " ", " ", "　", " ", "\x85", "\x1c", "\x0b", ".", "--", "12", "½", "<|endoftext|>", "<|endof", "|>", "ing", "aaaa", "’", "́", "Ⅷ", "\x00"]


@pytest.fixture(scope="module")
def counter():
    return prefix_tokens.PrefixCounter()


@pytest.fixture(scope="module")
def library():
    t = subwords.load(prefix_tokens.VOCABULARY)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def _check(counter, library, text):
    raw = text.encode()
    starts, ends, _ = prefix_tokens.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    cut = [raw[a:z].decode() for a, z in zip(starts, ends, strict=True)]
    assert "".join(cut) == text
    assert sum(map(counter.number, cut)) == library(text)
    got, base = [], 0
    for c in cut:
        got += (base + counter.chunk(c)).tolist()
        base = got[-1]
    assert got == [library(text[: k + 1]) for k in range(len(text))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_every_prefix(counter, library, text):
    _check(counter, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_every_prefix_of_any_text(counter, library, text):
    _check(counter, library, text)


def test_small_stores(library, monkeypatch):
    monkeypatch.setattr(prefix_tokens, "KEPT", 3)
    rng, counter = random.Random(1), prefix_tokens.PrefixCounter()
    for _ in range(50):
        _check(counter, library, "".join(rng.choices(PARTS, k=8)))


def _docs():
    rng = random.Random(4)
    docs = [(i, "".join(rng.choices(PARTS, k=rng.randint(1, 40)))) for i in range(40)]
    return [*docs, (40, None), (41, ""), (None, "null id"), docs[3], docs[3], (42, "long words " * 30_000), (43, "b" * 5000), (44, "ünï " * 3000)]


def test_counts(spark, library):
    docs = _docs()
    got = prefix_tokens.count_tokens(spark.createDataFrame([(i, t, 9, "clash") for i, t in docs], DOCS).repartition(3), limit=100).collect()
    want = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 100) for i, t in docs]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert prefix_tokens.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_questions_to_the_stored_table(spark, library):
    docs = [(i, t) for i, t in _docs() if len(t or "") < 200]
    table = prefix_tokens.prefix_table(spark.createDataFrame([(i, t, 9, "clash") for i, t in docs], DOCS))
    rows = table.select("doc_id", F.size("counts").alias("n"), prefix_tokens.tokens_of_prefix(7).alias("seven"), prefix_tokens.longest_prefix(5).alias("fit"), prefix_tokens.first_over(5).alias("over"), F.element_at("counts", -1).alias("all")).collect()
    texts = _by_id(docs)
    for r in rows:
        text = texts[r.doc_id]
        counts = [library(text[:k]) for k in range(len(text) + 1)]
        assert (r.n, r.seven, r.all) == (len(text) + 1, library(text[:7]), library(text))
        assert r.fit == max(k for k, n in enumerate(counts) if n <= 5)
        assert r.over == min((k for k, n in enumerate(counts) if n > 5), default=None)
    assert prefix_tokens.prefix_table(spark.createDataFrame([], DOCS)).count() == 0


def _by_id(docs):
    return {i: t or "" for i, t in docs}
