"""The whole pipeline against plain models of its stages, each on what the model of the one before it kept."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import mixing, packing, subwords

from . import brute
from .test_llm import _plain_templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(seed):
    """Rows of documents: clean ones with template lines, near copies, rejected ones, nulls."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ke", "su") for b in ("n", "l", "v", "ch") for c in ("er", "a", "io", "um", "est")]
    words = lambda n: " ".join(rng.choices(vocab, k=n))
    docs = []
    for i in range(120):
        kind = rng.random()
        lines = [words(rng.randint(20, 60)) for _ in range(rng.randint(3, 5))]
        if kind < 0.3:
            lines.insert(rng.randrange(len(lines)), f"this page was made by {rng.choice(vocab)} for all who read it")
        if 0.2 < kind < 0.45:
            lines.append("all rights reserved by the owners of the site")
        text = "\n".join(lines)
        if kind > 0.85:
            text = words(rng.randint(1, 40))  # too short
        elif kind > 0.75:
            text = "\n".join([words(12)] * 8)  # repeats itself
        elif kind > 0.55 and docs:
            text = rng.choice(docs)[1] or text
            if kind > 0.62:  # a near copy, with one word changed
                w = text.split(" ")
                w[rng.randrange(len(w))] = "edited"
                text = " ".join(w)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, words(3000))]
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in docs]


def _good(text):
    n, chars, symbols, dup_lines, repeated = brute.measures(text)
    lines = sum(1 for x in (text or "").split("\n") if brute.WORD.search(x))
    return n >= 50 and 100 * repeated <= 50 * n and 100 * symbols <= 15 * n and 100 * dup_lines <= 50 * lines and 2 * n <= chars <= 20 * n


def _without_templates(rows):
    """Texts by doc_id after line dedup; a document of nothing else is gone."""
    docs = [(r[0], r[1]) for r in rows]
    gone = _plain_templates(docs, 10)
    out = {}
    for d in docs:
        left = [t for n, t in enumerate((d[1] or "").split("\n")) if (d, n) not in gone]
        dropped = any(x == d for x, _ in gone)
        if not dropped or any(brute.words(t) for t in left):
            out[d[0]] = "\n".join(left)
    return out


def _targets(size):
    """Words of each source by water filling."""
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), [5, 2, 1], strict=False))
    left, targets = 1.5 * sum(size.values()), {}
    while True:
        waiting = [s for s in size if s not in targets]
        share = {s: left * weights[s] / sum(weights[x] for x in waiting) for s in waiting}
        over = [s for s in waiting if share[s] > 2 * size[s]]
        if not over:
            return targets | share
        for s in over:
            targets[s] = 2.0 * size[s]
            left -= targets[s]


@pytest.mark.parametrize("seed", [8, 21])
def test_pipeline_against_plain_models(spark, tmp_path, seed):
    import corpus_pipeline

    rows = _docs(seed)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    good = [r for r in rows if _good(r[1])]
    texts = _without_templates(good)
    cut = sum(texts.get(r[0]) != r[1] for r in good)
    classes = {i: c for i, _, c in brute.jaccard(sorted(texts.items()))}
    kept = [i for i in sorted(texts) if classes[i] == i]
    assert 60 < len(good) < len(rows) - 20 and cut > 20 and len(kept) < len(texts) - 10

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = subwords.load(packing.VOCABULARY)
    times = collections.Counter(r.doc_id for r in pieces if r.piece == 0)

    # only what the model keeps is packed, whole, with the model's text
    want = collections.Counter()
    for i in times:
        assert i in kept
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[i, p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += times[i]
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want

    # each document as often as queues of the sources send it, but for the one at each source's cut
    source = {r[0]: r[3] for r in rows}
    size, by_source = collections.Counter(), collections.defaultdict(list)
    for i in kept:
        size[source[i]] += len(brute.words(texts[i]))
    frame = spark.createDataFrame([(i, texts[i], source[i]) for i in kept], "doc_id long, text string, source string")
    identity = F.xxhash64("doc_id", "text", "source")
    for r in frame.select("doc_id", "source", identity.alias("i"), "text").select("*", F.xxhash64(F.lit(mixing._VERSION), "i", "text").alias("h")).collect():
        by_source[r.source].append((r.h, r.i, r.doc_id))
    for s, target in _targets(size).items():
        left, sent = round(target), collections.Counter()
        queue = [i for _, _, i in sorted(by_source[s])] * 2
        for i in queue:
            n = min(len(brute.words(texts[i])), max(left, 0))
            sent[i] += n
            left -= n
        for i in set(queue):
            n = len(brute.words(texts[i]))
            assert abs(times[i] - sent[i] / n) <= 0.5 + 2 / n, (s, i)

    # sequences have no gaps and are few
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in pieces)
    assert len(by) <= 1.15 * total / 2048 + 2


def test_pipeline_of_nothing(spark, tmp_path):
    """Tables of which nothing stays, and without rows."""
    import corpus_pipeline

    for name, rows in (("none", []), ("poor", [(1, None, "en", "a", 0), (2, "a few words", "en", None, 11)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
