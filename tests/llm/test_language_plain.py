"""Language identification against a plain scorer that counts in dictionaries, one word at a time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from marketlens.llm import language_id

SMOOTH = 0.5
ALPHABETS = {"aa": "abcdeéo", "bb": "abxyzñ", "cc": "жшabя", "dd": "xyzкж"}


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _words(text):
    return re.findall("[^\x20\x09-\x0d]+", _lower(text))


def _grams(word, n):
    padded = f" {word} "
    out = [padded[k : k + n] for k in range(len(padded) - n + 1)]
    return [g for g in out if g != " "]


def plain(docs):
    """(held out, language, score) of each document."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = {n: defaultdict(Counter) for n in (0, 1, 2, 3, 4, 5)}
    for i, text, lang in set(docs):
        if held(i) or text is None or lang is None:
            continue
        for w in _words(text):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(_grams(w, n))
    langs = sorted(counts[0])
    logs = {}
    for n, by in counts.items():
        both = sum(by.values(), Counter())
        for key, times in both.items():
            if times >= 2:
                logs[n, key] = [math.log((by[x][key] + SMOOTH) / (by[x].total() + SMOOTH * (len(both) + 1))) for x in langs]

    def of(word):
        if (0, word) in logs:
            return logs[0, word]
        for n in (5, 4, 3, 2, 1):
            known = [logs[n, g] for g in _grams(word, n) if (n, g) in logs]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(langs)

    out = []
    for i, text, _ in docs:
        if text is None or not any(c.isalpha() for c in text):
            out.append((i, held(i), "und", 0.0, 1.0))
            continue
        sums = [sum(x) for x in zip(*[of(w) for w in _words(text)], strict=True)]
        first, *rest = sorted(sums, reverse=True)
        out.append((i, held(i), langs[sums.index(first)], 1 / sum(math.exp(s - first) for s in sums), first - rest[0]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_prediction_is_the_plain_one(spark, seed):
    rng = random.Random(seed)
    vocabulary = {x: ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(60)] for x, letters in ALPHABETS.items()}
    docs = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 -- 3", "cc"), (1003, "QQQ wwww", None), (1004, "Ω", "dd")]
    for i in range(300):
        lang = rng.choice(sorted(ALPHABETS))
        words = [rng.choice(vocabulary[lang]) if rng.random() < 0.7 else "".join(rng.choices(ALPHABETS[lang], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12))]
        docs.append((i, rng.choice([" ", "\t", " \n"]).join(w.upper() if rng.random() < 0.1 else w for w in words), lang if rng.random() < 0.9 else None))
    docs += docs[20:40]  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = sorted((r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.identify(df).collect())
    want = sorted(plain(docs))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[3] == pytest.approx(w[3], abs=1e-3)
        assert g[2] == w[2] or 0 < w[4] < 1e-3, (g, w)
