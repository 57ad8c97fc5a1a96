"""The ten operators against brute force, exact round trips and held-out accuracy, and their defined odd cases."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import attention_lm, graphs, jaccard_join, language_id, line_templates, mixing, packing, quality_rules, queries, substring_dedup, subwords, suffix_dedup, tables, vector_search, windows
from marketlens.llm import text as tx

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, trigger long, h long"


def _frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in docs], DOCS)


def _corpus(seed, n=40):
    """Documents of few words with copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["Été", "naïve", "ÜBER", "1,5", "a b"]
    passage = " ".join(rng.choices(vocab, k=130))
    docs = []
    for i in range(n):
        t = " ".join(rng.choices(vocab, k=rng.randint(1, 160)))
        kind = rng.random()
        if kind < 0.2 and docs:
            t = rng.choice(docs)[1] or ""
        elif kind < 0.4 and docs:
            w = (rng.choice(docs)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        elif kind < 0.6:
            t = t + "\n" + passage + " " + " ".join(rng.choices(vocab, k=20))
        docs.append((i, t))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "aaaa " * 200), (n + 5, "b" * 1500), (None, docs[3][1]), (7, docs[7][1]), (n + 6, "two words")]
    return docs


@pytest.fixture(scope="module")
def corpus():
    return _corpus(5)


@pytest.fixture(scope="module")
def frame(spark, corpus):
    return _frame(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_suffix_dedup(frame, corpus):
    assert _sorted(suffix_dedup.remove_repeats(frame).collect()) == _sorted(brute.bytes_dedup(corpus))


def test_suffix_dedup_round_trip(frame, corpus):
    import hashlib

    for r in suffix_dedup.remove_repeats(frame, with_text=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_substring_dedup(frame, corpus):
    assert _sorted(substring_dedup.remove_repeats(frame).collect()) == _sorted(brute.words_dedup(corpus))


@pytest.mark.parametrize("length", [12, 35])
def test_crowded_triggers_are_split(frame, corpus, length, monkeypatch):
    monkeypatch.setattr(windows, "CROWDED", 2)
    assert _sorted(substring_dedup.remove_repeats(frame, length, 5).collect()) == _sorted(brute.words_dedup(corpus, length))


def test_crowded_triggers_of_bytes_are_split(spark, monkeypatch):
    """One passage in many contexts: every window about its triggers is crowded."""
    monkeypatch.setattr(windows, "CROWDED", 3)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(12))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 20))) + " " + passage[rng.randint(0, 9) :] + " " + " ".join(word() for _ in range(rng.randint(0, 20)))) for i in range(60)]
    assert _sorted(suffix_dedup.remove_repeats(_frame(spark, docs), 48, 12).collect()) == _sorted(brute.bytes_dedup(docs, 48))


def test_small_resolver_parts(frame, corpus, monkeypatch):
    monkeypatch.setattr(windows, "RESOLVED", {"u1": 1000, "u8": 100})
    assert _sorted(suffix_dedup.remove_repeats(frame).collect()) == _sorted(brute.bytes_dedup(corpus))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=0, max_size=40), min_size=1, max_size=6), st.integers(2, 6))
def test_resolvers_agree_with_brute_force(runs, length):
    values = np.array([x for r in runs for x in r], dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
    times = np.ones(len(runs), np.int64)
    count = collections.Counter(tuple(r[k : k + length]) for r in runs for k in range(len(r) - length + 1))
    want = [count[tuple(r[k : k + length])] > 1 if k + length <= len(r) else False for r in runs for k in range(len(r))]
    assert suffix_dedup.resolve(values, bounds, times, length).tolist() == want
    assert substring_dedup.resolve(values, bounds, times, length).tolist() == want
    assert suffix_dedup.resolve(values.astype(np.uint8), bounds, times, length).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), min_size=1, max_size=5))
def test_phrases_cover_each_window_once(texts):
    data, offsets = tx.column_bytes(pa.array(texts))
    of, lo, hi, *_ = windows.phrases(data, offsets, 8, 3)
    got = sorted((d, x) for d, a, b in zip(of, lo, hi, strict=True) for x in range(a, b + 1))
    assert got == [(d, x) for d, t in enumerate(texts) for x in range(len(t) - 7)]


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(1, None, "a"), (2, "x y", "a"), (2, "x y", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert _sorted(rows) == _sorted(again) and len(rows) == len(docs)
    size = collections.Counter()
    for _, t, s in docs:
        size[s] += len(brute.words(t))
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), [5, 2, 1, 5, 2], strict=True))
    left, targets = 1.5 * sum(size.values()), {}
    while True:  # water filling by its definition
        open_ = [s for s in size if s not in targets]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 2.0 * size[s]
            left -= targets[s]
    taken = collections.Counter()
    for r in rows:
        assert r.taken <= 2 * r["size"]
        taken[round(r.target, 3)] += r.taken
    want = collections.Counter()
    for s in size:
        want[round(targets[s], 3)] += targets[s]
    assert taken.keys() == want.keys() and all(abs(taken[k] - want[k]) <= 2 for k in want)


def test_mixed_documents_keep_columns(frame):
    out = mixing.mix_documents(frame)
    assert out.columns == frame.columns and out.groupBy("doc_id", "text").count().where("count > 4").count() == 0


def test_mixing_by_document(spark):
    """taken of every document, by a model that sends queues and stops at the budget."""
    rng = random.Random(6)
    docs = [(i, " ".join(["w"] * rng.randint(1, 40)), "abc"[rng.randrange(3)]) for i in range(150)]
    rows = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    order = {r.doc_id: r.h for r in spark.createDataFrame(docs, "doc_id long, text string, source string").select("doc_id", F.xxhash64(F.lit(mixing._VERSION), "doc_id", "text").alias("h")).collect()}
    for source in "abc":
        own = sorted((order[i], i, len(t.split())) for i, t, s in docs if s == source)
        left, want = round(rows[own[0][1]].target), collections.Counter()
        for _, i, size in own * 2:
            want[i] += min(size, left)
            left -= min(size, left)
        assert all(abs(rows[i].taken - want[i]) <= 1 for _, i, _ in own)


def test_mixed_copies_share_what_is_taken(spark):
    docs = [(1, "a b c", "x", 7)] * 5 + [(1, "a b c", "x", 8)] * 2 + [(i, "q r s", "xy"[i % 2], 0) for i in range(2, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, mix long")
    identity = F.xxhash64("doc_id", "text", "source")
    counts = mixing.mix(df.select(identity.alias("doc_id"), "text", "source"))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    taken = {r.doc_id: r.t for r in counts.groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()}
    got = {r.i: r["count"] for r in out.groupBy(identity.alias("i")).count().collect()}
    assert all(got.get(i, 0) == round(t / 3) for i, t in taken.items())


def test_mixing_odd_tables(spark, empty):
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r.taken, r.target) for r in mixing.mix(none).collect()} == {(0, 0, 0.0)}


def test_quality_measures(frame, corpus):
    got = quality_rules.apply_rules(frame).collect()
    assert _sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == _sorted((i, *brute.measures(t)) for i, t in corpus)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_filter_and_ablation(frame, corpus):
    led = quality_rules.apply_rules(frame)
    kept = quality_rules.filter_documents(frame)
    assert kept.columns == frame.columns and kept.count() == led.where("kept").count()
    for r in quality_rules.ablation(led).collect():
        bit = quality_rules.mask([r.rule])
        whole = quality_rules.mask(quality_rules.POLICIES[quality_rules.POLICY])
        assert r.fails == led.where(f"failed & {bit} != 0").count() and r.kept_without == led.where(f"failed & {whole & ~bit} = 0").count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab #|\n\té漢"), max_size=40), min_size=1, max_size=4))
def test_quality_measures_of_any_text(texts):
    data, offsets = tx.column_bytes(pa.array(texts))
    got = quality_rules._measure(data, offsets)
    assert [tuple(int(c[k]) for c in got[:5]) for k in range(len(texts))] == [brute.measures(t) for t in texts]


def test_line_templates(spark):
    docs = [(i, f"Visit page {i} of our site today\nown line number x{'abcdefghijklmnopqrstuvwxyz'[i]} {'q' * i} here\n\nmany thanks for reading this {'bcdefghijklmnopqrstuvwxyz'[i % 20]} page again my dear friends") for i in range(14)]
    docs += [(50, None), (51, ""), (52, "\n\n"), (None, "Visit page 99 of our site today"), (5, docs[5][1])]
    df = _frame(spark, docs)
    out = line_templates.drop_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_removed"] and out.count() == len(docs)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert [i for i in range(14) if "Visit page" in got[i].text] == []  # the row without an id comes first and keeps it
    assert [i for i in range(14) if "for reading" in got[i].text] == [0]
    assert all("own line number" in got[i].text for i in range(14))
    assert got[50].text is None and got[51].text == "" and got[52].text == "\n\n"
    assert [r.text for r in out.where("doc_id is null").collect()] == ["Visit page 99 of our site today"]
    assert line_templates.filter_documents(df).count() == len(docs)


def _plain_templates(docs, min_documents):
    """(row, line) of the lines to drop, by a plain tree: leaves as lists of lines, each line compared with the others."""
    rows = {d: [x for x in enumerate((d[1] or "").split("\n")) if brute.words(x[1])] for d in docs}
    leaves = collections.defaultdict(list)
    for d, own in rows.items():
        for n, t in own:
            m = tuple("*" if any(c in "0123456789" for c in w) else w for w in brute.words(t))
            leaves[len(m), m[:3]].append((d, n, m))
    found = collections.defaultdict(list)
    for leaf, own in leaves.items():
        for d, n, m in own:
            alike = [sum(x[2][p] == w for x in own) for p, w in enumerate(m)]
            alike = [a if a >= min_documents else 0 for a in alike]
            rest = sorted(alike[3:])
            middle = rest[len(rest) // 2] if rest else 0
            kept = tuple(w if a and (p < 3 or 2 * a >= middle) else None for p, (w, a) in enumerate(zip(m, alike, strict=True)))
            wild = kept.count(None)
            found[(leaf, kept) if wild and 10 * (len(m) - wild) >= 8 * len(m) else (leaf, m, "own")].append((d, n))
    gone = set()
    for own in found.values():
        if len({d for d, _ in own}) >= min_documents:
            first = min(own, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
            gone |= set(own) - {first}
    return gone


@pytest.mark.parametrize("v", [3, 5, 9, 10, 12, 30])
def test_line_templates_do_not_hang_on_size(spark, v):
    """Two fields of v values each, every pair once: one template, however often a value comes."""
    word = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:02d}")
    docs = [(v * a + b, f"{word(a)} {word(b)} alone\nthis notice was posted by {word(a)} in the section {word(b)} of our public site") for a in range(v) for b in range(v)]
    docs += [(10_000 + k, f"this notice was quite another line with {word(k)} as its one and last word") for k in range(15)]
    out = line_templates.drop_lines(_frame(spark, docs), 9).collect()
    posted = [r.doc_id for r in out if "posted by" in r.text]
    assert posted == [0] and sum("another line" in r.text for r in out) == 1
    assert all("alone" in r.text for r in out if r.doc_id < 10_000)


def test_templates_of_one_leaf_are_told_apart(spark):
    """A rare template with a field beside a frequent one with other words, in one leaf."""
    word = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03d}")
    docs = [(i, f"we are now selling item {word(i % 40)} at the best price you will find") for i in range(400)]
    docs += [(1000 + i, f"we are now closing shop number {word(i)} because of low demand since spring") for i in range(20)]
    docs += [(2000 + i, " ".join(["we are now", *(word(100 + 10 * i + k) for k in range(10))])) for i in range(30)]
    left = [r.doc_id for r in line_templates.drop_lines(_frame(spark, docs)).where("text <> ''").collect()]
    assert sorted(left) == [0, 1000, *range(2000, 2030)]


@pytest.mark.parametrize("min_documents", [2, 4])
def test_line_templates_against_a_plain_tree(spark, min_documents):
    rng = random.Random(min_documents)
    frames = ["see the page of {} for all of our news and offers", "posted by {} on our site", "all rights {} reserved by us and by them", "a b c d {} f g h i {}", "plain line"]
    docs = []
    for i in range(120):
        own = [rng.choice(frames).format(*(rng.choice(["x", "y", "z7", "q" * rng.randint(1, 9)]) for _ in range(2))) for _ in range(rng.randint(0, 4))]
        docs.append((i, "\n".join(own) if own else None))
    docs += [docs[3], docs[4]]
    gone = _plain_templates(docs, min_documents)
    want = sorted((d[0], None if d[1] is None else "\n".join(t for n, t in enumerate(d[1].split("\n")) if (d, n) not in gone)) for d in docs)
    got = sorted((r.doc_id, r.text) for r in line_templates.drop_lines(_frame(spark, docs), min_documents).collect())
    assert len(gone) > 50 and got == want


def test_crowded_leaves_are_generalised(spark):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:04d}")
    docs = [(i, f"Posted by the user {name(i)} on our site") for i in range(1200)]
    assert line_templates.drop_lines(_frame(spark, docs)).agg(F.sum("_n_removed")).first()[0] == 1199


def test_packing(frame, corpus):
    rows = packing.pack_documents(frame).collect()
    tok = subwords.load(packing.VOCABULARY)
    want = []
    for i, t in corpus:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want.append((i, p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert _sorted(tuple(r)[:5] for r in rows) == _sorted(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_configurations_cover_the_histogram(histogram):
    plan = packing.configurations(histogram, 64, 40)
    total = collections.Counter()
    for config, times in plan:
        assert sum(k * n for k, n in config.items()) <= 64
        for k, n in config.items():
            total[k] += n * times
    assert total == histogram
    bound = -(-sum(k * n for k, n in histogram.items()) // 64)
    big = sum(n for k, n in histogram.items() if k > 32)
    assert sum(t for _, t in plan) <= max(bound, big) * 1.35 + 2


def test_subwords_are_the_tokenizers(corpus):
    tok = subwords.load(packing.VOCABULARY)
    encoder = subwords.Encoder(tok)
    odd = ["İstanbul ΑΣ", "don't I'LL x<|endoftext|>y", "é á 1²3", "ǅabc ß ŉ 中文 's it's'll ªº", " em space\x85x", ""]
    texts = [t or "" for _, t in corpus] + odd
    data, offsets = tx.column_bytes(pa.array(texts))
    ids, bounds = encoder.ids(data, offsets)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n = got.count()
    assert n > 20 and got.where("lang = lang_pred").count() >= 0.95 * n
    odd = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(9001, None, "en"), (9002, "12 3!", "en"), (9003, "", None), (None, "the of and", "en")], "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0.0 for i in (9001, 9002, 9003)) and rows[None].held_out
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_id_without_training(empty, frame):
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[1000:1400] = x[0] + rng.normal(scale=1e-3, size=(400, 24))  # near copies
    x[1400:1420] = x[50]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] + [1.0] * 23), (5200, [float("inf")] * 24), (5250, []), (5300, [1.0, 2.0]), (50, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vector_search.search(df, df.where("vec_id % 50 = 0"), shard_rows=400).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(float)
    norm = np.linalg.norm(y, axis=1)
    hits = total = 0
    for q in range(0, 1500, 50):
        s = (y @ y[q]) / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(v != q for _, v, _ in mine)
        assert all(abs(sc - s[v]) < 1e-12 for _, v, sc in mine)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:], strict=False))
        hits += len({v for _, v, _ in mine} & set(best.tolist()))
        total += 5
    assert hits / total >= 0.9
    assert set(got) == set(range(0, 1500, 50))
    assert [v for _, v, _ in sorted(got[50])] == [1400, 1401, 1402, 1403, 1404]


@pytest.mark.parametrize("scale", [1e200, 1e-200])
def test_vector_search_of_any_length(spark, scale):
    """Cosines do not depend on lengths, near the ends of the doubles either; near copies are told apart."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    x[60:] = x[0] + rng.normal(scale=1e-6, size=(60, 8))
    rows = [(i, (v * (scale if i % 2 else 1.0)).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = collections.defaultdict(list)
    for r in vector_search.search(df, df.where("vec_id % 50 = 0")).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == {0, 50, 100}
    for q, got in found.items():
        s = unit @ unit[q]
        s[q] = -9
        assert [v for _, v, _ in sorted(got)][:3] == np.argsort(-s, kind="stable")[:3].tolist() or np.isclose(np.sort(s)[-5:][::-1], [c for _, _, c in sorted(got)], atol=1e-15).all()
        assert all(abs(c - s[v]) < 1e-12 for _, v, c in got)


def test_vector_search_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.search(df, df).count() == 0


def test_jaccard_join(frame, corpus):
    assert _sorted(jaccard_join.join(frame).collect()) == _sorted(brute.jaccard(corpus))


def test_jaccard_join_of_small_sets(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("ABcd", k=rng.randint(1, 9)))) for i in range(120)]
    assert _sorted(jaccard_join.join(_frame(spark, docs)).collect()) == _sorted(brute.jaccard(docs))


def _families(seed=3):
    """Groups of copies of a text with edits of very different numbers, some around a passage that all share."""
    rng = random.Random(seed)
    docs = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(60)] + [f"all{k}" for k in range(12)] * (g % 3 == 0)
        for c in range(14):
            edited = list(words)
            for k in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3, 4, 6])):
                edited[k] = f"e{g}x{c}x{k}"
            docs.append((len(docs), " ".join(edited[: rng.choice([60, 72, 50])])))
    return docs


@pytest.mark.parametrize("block", [1, 3, 256])
@pytest.mark.parametrize("pivots", [True, False])
def test_jaccard_join_loses_no_link(spark, monkeypatch, block, pivots):
    """With and without pivots, and with lists cut into many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    if not pivots:
        monkeypatch.setattr(jaccard_join, "_pivots", lambda lists, percent, f=jaccard_join._pivots: f(lists, percent).where("false"))
    docs = _families()
    assert _sorted(jaccard_join.join(_frame(spark, docs)).collect()) == _sorted(brute.jaccard(docs))


def test_keep_one(frame, corpus):
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    rows = brute.jaccard(corpus)
    want = len({c for i, n, c in rows if n}) + len({(i, corpus[k][1]) for k, (i, n, c) in enumerate(rows) if not n})
    assert kept.count() == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(k, k + 1) for k in range(300, 340)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def _counts(docs):
    c = collections.Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(brute.words(brute.low(t)))
            c["\n"] += 1  # the end
    return c


@pytest.mark.parametrize("top", [1 << 17, 3])
def test_base_scores(frame, corpus, top, monkeypatch):
    monkeypatch.setattr(attention_lm, "TOP_WORDS", top)
    monkeypatch.setattr(attention_lm, "STEPS", 3)
    c = _counts(corpus)
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in corpus:
        tokens = [*brute.words(brute.low(t)), "\n"]
        held = i is None or zlib.crc32(str(i).encode()) % 5 == 1
        want.append((i, held, len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), 6)))
    got = attention_lm.score_documents(frame).collect()
    assert _sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == _sorted(want)
    assert all(r.score < 0 for r in got)


def test_attention_lm_learns_and_sums_to_one():
    rng = np.random.default_rng(0)
    seqs = [np.array([(s * 7 + k) % 50 + 100 for k in range(60)], dtype=np.uint32) for s in rng.integers(0, 50, 200)]
    model = attention_lm.train(seqs[:160])
    table = model.table()
    ids = np.concatenate(seqs[160:])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in seqs[160:]])])
    whole = attention_lm.score(model, table, ids, bounds)
    alone = [attention_lm.score(model, table, s, np.array([0, len(s)]))[0] for s in seqs[160:]]
    assert np.allclose(whole, alone, atol=1e-3)
    assert whole.mean() > 61 * np.log10(1 / 51) * 0.75  # better than knowing the 51 ids alone


@pytest.mark.parametrize("most", [0, 1, 7, 40, 100, 10_000])
def test_most_frequent(spark, most):
    rng = random.Random(most)
    rows = [(k, rng.choice([1, 1, 1, 2, 2, 3, 9])) for k in range(300)]
    got = tables.most_frequent(spark.createDataFrame(rows, "key long, n long"), "n", "key", most).collect()
    ranked = sorted((n for _, n in rows), reverse=True)
    last = ranked[min(most, len(rows)) - 1] if most else 99
    assert len(got) <= most and {r.key for r in got} >= {k for k, n in rows if n > last and sum(m >= n for _, m in rows) <= most}
    assert most < len(rows) or len(got) == len(rows)


def _reference_scores(model, ids):
    """log10 of the attention model's probability of each id and the end, one position at a time."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    seen = [attention_lm.END, *ids.tolist()]
    out = []
    for t, want in enumerate([*ids.tolist(), attention_lm.END]):
        first = t // attention_lm.SCORED * attention_lm.SCORED
        at = [j for j in range(max(0, first - attention_lm.CONTEXT), t + 1)]
        e = p["e"][model.place[[seen[j] for j in at]]]
        x = e[-1]
        a = (e @ p["k"]) @ (x @ p["q"]) / np.sqrt(attention_lm.WIDTH) + p["d"][[t - j for j in at]]
        a = np.exp(a - a.max())
        o = (a / a.sum()) @ (e @ p["v"])
        y = np.maximum(x @ p["hx"] + o @ p["ho"] + p["hb"], 0) @ p["w"] + p["b"]
        y = np.exp(y - y.max())
        out.append(np.log10(y[model.group[want]] / y.sum()) + model.inside[want])
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(30)]
    docs = [(i, " ".join(rng.choices(vocab, weights=range(1, 31), k=rng.randint(1, 60)))) for i in range(80)]
    return attention_lm.fit(_frame(spark, docs).select("doc_id", "text")), docs


def test_attention_lm_forward_pass(fitted):
    import dataclasses

    model, docs = fitted
    alone = dataclasses.replace(model, memories=())
    data, offsets = tx.column_bytes(pa.array([t for _, t in docs[:6]]))
    ids, bounds = subwords.Encoder.of(attention_lm.VOCABULARY).ids(data, offsets)
    got = attention_lm.score(alone, alone.table(), ids, bounds)
    want = [sum(_reference_scores(alone, ids[a:z])) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    assert np.allclose(got, want, atol=1e-3)


def test_attention_lm_sums_to_one(fitted):
    """The probabilities of all ids after a prefix: of the attention's classes and shares, then with pairs and triples."""
    model, docs = fitted
    data, offsets = tx.column_bytes(pa.array([docs[0][1]]))
    prefix = subwords.Encoder.of(attention_lm.VOCABULARY).ids(data, offsets)[0][:7].astype(np.int64)
    classes, every = np.zeros(attention_lm.CLASSES), np.arange(attention_lm.IDS)
    # the classes' probabilities: one id of each class, scored as the next one
    for c in np.unique(model.group):
        x = int(np.flatnonzero(model.group == c)[0])
        classes[c] = 10 ** (_reference_scores(model, np.array([*prefix, x]))[len(prefix)] - model.inside[x])
    share = classes[model.group] * 10.0**model.inside
    assert abs(share.sum() - 1) < 1e-6
    one, two = np.full(every.size, prefix[-1]), np.full(every.size, prefix[-2] * attention_lm.IDS + prefix[-1])
    for memory, context in zip(model.memories, (one, two), strict=True):
        own, rest = memory.find(context, every)
        share = own + rest * share
    assert abs(share.sum() - 1) < 1e-6 and (share > 0).all()


def test_attention_lm_beats_its_parts(spark, sf):
    """On held-out documents pairs and triples help the attention, and the attention is better than the ids' shares."""
    import dataclasses

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    held = attention_lm.in_fold("doc_id", 5, 1)
    model = attention_lm.fit(docs.where(~held).select("doc_id", "text"))
    data, offsets = tx.column_bytes(pa.array([r.text for r in docs.where(held).select("text").collect()]))
    ids, bounds = subwords.Encoder.of(attention_lm.VOCABULARY).ids(data, offsets)
    whole = attention_lm.score(model, model.table(), ids, bounds).sum()
    alone = dataclasses.replace(model, memories=())
    attention = attention_lm.score(alone, alone.table(), ids, bounds).sum()
    # the ids alone: a class's share is its bias
    bias = model.p["b"] - np.log(np.exp(model.p["b"]).sum())
    shares = (bias[model.group] / np.log(10) + model.inside)[np.concatenate([ids, np.full(len(bounds) - 1, attention_lm.END)])].sum()
    assert whole > attention > shares


def test_attention_lm_counts_every_training_document(spark):
    words = [f"{a} {b}" for a in ("red", "blue", "green") for b in ("stone", "river", "cloud")]
    docs = [(i, f"{words[i % 9]} and {words[i % 7]}" + " marmalade" * (i % 100 == 99)) for i in range(2500)]
    model = attention_lm.fit(_frame(spark, docs).repartition(5).select("doc_id", "text"))
    data, offsets = tx.column_bytes(pa.array([t for _, t in docs]))
    counts = np.bincount(subwords.Encoder.of(attention_lm.VOCABULARY).ids(data, offsets)[0], minlength=attention_lm.IDS)
    counts[attention_lm.END] += len(docs)
    weight = counts + np.where(model.place == model.place.max(), 1.0, 0.01)
    assert np.allclose(model.inside, np.log10(weight / np.bincount(model.group, weights=weight)[model.group]))


def test_attention_lm_shards_and_rounds_learn(spark, monkeypatch):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join("ten cats saw nine dogs near two old red barns".split()[(s + k) % 10] for k in range(40))) for i, s in enumerate(rng.integers(0, 10, 400))]
    frame = _frame(spark, docs).select("doc_id", "text")
    monkeypatch.setattr(attention_lm, "SHARD_IDS", 4000)
    model, again = attention_lm.fit(frame.repartition(3)), attention_lm.fit(frame.repartition(7))
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-3) for k in model.p)  # however the rows lie
    data, offsets = tx.column_bytes(pa.array([t for _, t in docs[:50]]))
    ids, bounds = subwords.Encoder.of(attention_lm.VOCABULARY).ids(data, offsets)
    assert attention_lm.score(model, model.table(), ids, bounds).mean() > 41 * np.log10(1 / 11) * 0.5


def test_attention_lm_odd_tables(spark, empty):
    assert attention_lm.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = attention_lm.score_documents(_frame(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


@pytest.mark.parametrize("name", ["remove_repeats", "words", "lines", "rules", "pack", "join", "keep"])
def test_empty_tables(empty, name):
    run = {"remove_repeats": suffix_dedup.remove_repeats, "words": substring_dedup.remove_repeats, "lines": line_templates.drop_lines, "rules": quality_rules.apply_rules, "pack": packing.pack_documents, "join": jaccard_join.join, "keep": jaccard_join.keep_one}[name]
    assert run(empty).count() == 0


@pytest.fixture(scope="module")
def long_docs():
    rng = random.Random(1)
    long_ = " ".join(str(rng.randrange(10**6)) for _ in range(300_000))
    return [(1, long_), (2, "short text"), (3, long_[1000:200_000])]


def test_very_long_text(spark, long_docs):
    r = {x.doc_id: x for x in suffix_dedup.remove_repeats(_frame(spark, long_docs)).collect()}
    assert r[1].n_removed == r[3].n_removed == 199_000 and r[2].n_removed == 0


def test_very_long_text_of_the_other_operators(spark, long_docs):
    df = _frame(spark, long_docs)
    counts = {i: len(t.split()) for i, t in long_docs}
    assert {r.doc_id: r.n_words for r in substring_dedup.remove_repeats(df).collect()} == counts
    assert {r.doc_id: r["size"] for r in mixing.mix(df).collect()} == counts
    assert {r.doc_id: r.n_words for r in quality_rules.apply_rules(df).collect()} == counts
    assert [r.text for r in line_templates.drop_lines(df).orderBy("doc_id").collect()] == [t for _, t in long_docs]
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id for r in language_id.identify(df).collect()} == {1, 2, 3}
    packed = packing.pack_documents(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert all(r.pieces == -(-r.n // 2048) for r in packed)
    scored = {r.doc_id: r.n_tokens for r in attention_lm.score_documents(df).collect()}
    assert scored == {i: n + 1 for i, n in counts.items()}


def test_clashing_columns(spark, corpus):
    """Columns named like those that operators and stages make for themselves are carried along, or ignored."""
    import corpus_pipeline

    names = ["rid", "h", "n", "trigger", "size", "taken", "_row", "_id", "_doc", "_rid", "_k", "_times", "component", "m", "cls"]
    df = _frame(spark, corpus).drop("trigger", "h").withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        rows = out.limit(50).collect()
        assert rows or name == "quality rules"
        assert all(r[c] == f"own {c}" for r in rows for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= len(corpus)
    for run in (suffix_dedup.remove_repeats, substring_dedup.remove_repeats, mixing.mix, jaccard_join.join, language_id.identify):
        assert run(df).count() == len(corpus)
    vectors = spark.createDataFrame([(i, [1.0, float(i)], "x", "y") for i in range(60)], "vec_id long, embedding array<double>, shard string, dim string")
    assert vector_search.search(vectors, vectors.where("vec_id % 50 = 0")).count() == 10


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = _corpus(8, 60)
    rows = [(i, t, "en", "ab"[k % 2], len(t or "")) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "source mixing", "best-fit packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, df, str(tmp_path))

    def clean(t):
        m = brute.measures(t)
        lines = sum(1 for x in (t or "").split("\n") if brute.WORD.search(x))
        return m[0] >= 50 and 100 * m[4] <= 50 * m[0] and 100 * m[2] <= 15 * m[0] and 100 * m[3] <= 50 * lines and 2 * m[0] <= m[1] <= 20 * m[0]

    want = [(i, t) for i, t in docs if clean(t)]
    assert _sorted((r.doc_id, r.text) for r in kept.collect()) == _sorted(want)
    one = stages["n-gram jaccard join"](spark, kept, str(tmp_path))
    groups = brute.jaccard(want)
    assert one.columns == df.columns and one.count() == len({c for _, _, c in groups})
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
