"""Pairs and triples of every frequency count in the scores, whether they are broadcast or joined."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import attention_lm as lm
from marketlens.llm import subwords
from marketlens.llm import text as tx


def _before(ids):
    """(both before, the one before, id) of each token of a document, the end among them."""
    one = [lm.END, *ids]
    return [((one[max(0, t - 1)] if t else lm.END, one[t]), one[t], x) for t, x in enumerate([*ids, lm.END])]


def _plain(docs, attention):
    """Scores by dictionaries: attention's share of each token, then pairs, then triples, with what each leaves."""
    pairs, triples = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for i, ids in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for two, one, x in _before(ids):
                pairs[one][x] += 1
                triples[two][x] += 1
    out = []
    for (_, ids), shares in zip(docs, attention, strict=True):
        total = 0.0
        for (two, one, x), p in zip(_before(ids), shares, strict=True):
            for seen in (pairs.get(one), triples.get(two)):
                if seen:
                    n = sum(seen.values())
                    p = (max(seen[x] - lm.DISCOUNT, 0) + lm.DISCOUNT * len(seen) * p) / n
            total += np.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("most", [1 << 19, 40, 5])
def test_rare_pairs_and_triples_count(spark, monkeypatch, most):
    monkeypatch.setattr(lm, "MEMORY", most)
    monkeypatch.setattr(lm, "STEPS", 3)
    rng = random.Random(11)
    words = "ten cats saw nine dogs near two old red barns while grey owls slept".split()
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 25)))) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    models, fitted = [], lm._fitted
    monkeypatch.setattr(lm, "_fitted", lambda *a: models.append(fitted(*a)) or models[-1])
    got = {r.doc_id: r.score for r in lm.score_documents(frame).collect()}
    model = lm.Model(models[0].place, models[0].group, models[0].inside, models[0].p)
    encoder = subwords.Encoder.of(lm.VOCABULARY)
    every, attention = [], []
    for i, t in docs:
        ids, _ = encoder.ids(*tx.column_bytes(pa.array([t])))
        ids = ids.astype(np.int64)
        # a prefix's score less the end's share: the scores of its tokens one after another
        every.append((i, ids.tolist()))
        attention.append(_shares(model, ids))
    want = _plain(every, attention)
    assert np.allclose([got[i] for i, _ in docs], want, atol=1e-3)


def _shares(model, ids):
    """The attention's share of each token, the end among them, by the documents that differ in one token only."""
    from tests.llm.test_llm import _reference_scores

    return 10.0 ** np.array(_reference_scores(model, ids))


def test_portions_and_places(monkeypatch):
    """Slices of lists hold every row once, whatever its length; numbers are found by hash, and others are not."""
    monkeypatch.setattr(lm, "PORTION", 5)
    rows = [[1, 2], [], [3] * 9, [4, 5, 6], [7, 8], [], [9]]
    whole = pa.array([[0], *rows], pa.list_(pa.int32())).slice(1)
    parts = [p.to_pylist() for p in lm._portions(whole)]
    assert [r for p in parts for r in p] == rows and all(len(p) == 1 or sum(map(len, p)) <= 5 for p in parts)
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3000):
        numbers = rng.choice(10**15, n, replace=False)
        places, by = lm.Places.of(numbers)
        at, hit = places.find(np.concatenate([numbers, numbers + 10**15]))
        assert hit[:n].all() and not hit[n:].any() and (numbers[by][at[:n]] == numbers).all()
