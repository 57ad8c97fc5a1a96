"""Phrase mining against a plain count of all phrases."""

import collections
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from marketlens.llm import phrases

from . import brute

DOCS = "doc_id long, text string, lang string, phrase string, n long"


def _plain(docs, max_words=4, least=30, top=2000, percent=80):
    """Rows (lang, rank, phrase, a, l, r, n, score) of docs (text, lang)."""
    f = collections.defaultdict(collections.Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                f[lang or "und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        total = sum(c for p, c in n.items() if len(p) == 1)
        found = {p: a for p, a in n.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            cuts = [(Fraction(2_000_000 * a, n[p[:k]] + n[p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            held = any(len(x) > len(p) and 100 * b >= percent * a and any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1)) for x, b in found.items())
            if not held:
                rows.append((-score, -a, " ".join(p), n[p[:k]], n[p[k:]]))
        out += [(lang, i, p, -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def _corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["The", "of", "ÉTÉ", "naïve", "x", "new", "york", "city", "a-b", " w", "漢字"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", " ; "]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(vocab) + rng.choice(glue) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.4:
            text += " new york city hall" * rng.randint(1, 3)
        docs.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    return docs + [(None, "en"), ("", None), (" \t\n", "fr"), (docs[0][0], docs[0][1]), ("one", "xx")]


def _frame(spark, docs):
    return spark.createDataFrame([(None if i % 7 == 0 else i, t, x, "clash", 5) for i, (t, x) in enumerate(docs)], DOCS)


@pytest.mark.parametrize(("budget", "burst"), [(None, None), (40, 3)])
@pytest.mark.parametrize(("least", "top"), [(5, 2000), (2, 7)])
def test_phrases_against_plain_counts(spark, budget, burst, least, top):
    docs = _corpus(1)
    got = phrases.collocations(_frame(spark, docs).repartition(3), least=least, top=top, budget=budget, burst=burst).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == _plain(docs, least=least, top=top)


def test_small_blocks_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_BLOCK", 64)
    docs = _corpus(2)
    for words in (2, 3):
        got = phrases.collocations(_frame(spark, docs), max_words=words, least=3)
        assert sorted(map(tuple, got.collect())) == _plain(docs, max_words=words, least=3)


def test_trie_bursts_spills_and_keeps_counts():
    import numpy as np

    rng = random.Random(3)
    trie, want, got = phrases.PhraseTrie(4, burst=4), collections.Counter(), collections.Counter()

    def take(ids, counts):
        for row, n in zip(ids.tolist(), counts.tolist(), strict=True):
            got[tuple(row)] += n

    for _ in range(30):
        block = collections.Counter(tuple(rng.choices(range(5), k=4)) for _ in range(50))
        want += block
        rows = sorted(block)
        trie.add(np.array(rows), np.array([block[x] for x in rows]))
        assert any(isinstance(x, tuple) for x in trie.root.values()) or trie.size < 20
        if trie.size > 60:
            take(*trie.spill(30))
            assert trie.size <= 30
    take(*trie.spill(-1))
    assert got == want and trie.size == 0 and not trie.root


def test_scores_pass_64_bits(spark):
    big = 3 * 10**15
    tables = [spark.createDataFrame(rows, "lang string, phrase string, n long") for rows in ([("en", "a", 2 * big), ("en", "b", big + 1)], [("en", "a b", big)])]
    row = phrases.scores(tables).first()
    assert (row.a, row.l, row.r, row.score) == (big, 2 * big, big + 1, 2_000_000 * big // (3 * big + 1))


def test_one_hot_document_group(spark):
    """Copies by the thousand: every phrase of the copy has the same count and score, and ties go by phrase."""
    copy = " ".join(f"w{k:03d}" for k in range(60))
    docs = [(copy, "en")] * 1500 + [("w000 w001 other", "en")] * 3
    got = phrases.collocations(_frame(spark, docs), top=20)
    assert sorted(map(tuple, got.collect())) == _plain(docs, top=20)


def test_empty_and_long(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    docs = [("new york is far. " * 40_000, None), ("new york", "und")]
    assert sorted(map(tuple, phrases.collocations(_frame(spark, docs)).collect())) == _plain(docs)


def test_ranges_of_prefixes_are_split(spark):
    """A first word that a third of all phrases share does not land in one partition of the merge."""
    runs = spark.range(20_000).select(F.lit("en").alias("lang"), F.format_string("the %05d", F.col("id")).alias("phrase"), F.lit(1).cast("long").alias("n"))
    parts = runs.repartitionByRange(4, "lang", "phrase").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 10_000
    assert phrases.merged(runs, 1).count() == 20_000
