"""Conversation repair against a plain dynamic program and against all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import conversation_repair as cr

ROWS = "conv_id long, turn long, role string, text string, copies string"
COUNTS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _sequences(rows, faults):
    """All edit sequences with at most two insertions between rows: (cost, audit, repaired rows)."""
    places = [[()] + [tuple(x) for k in (1, 2) for x in itertools.product(("user", "assistant"), repeat=k)]] * (len(rows) + 1)
    for inserted in itertools.product(*places):
        options = []
        for (role, text), fault in zip(rows, faults, strict=True):
            stay = [] if fault in ("blank", "duplicate") else [(3 * (fault == "truncated"), "K", (role, text))] + [(3 + 3 * (fault == "truncated"), "R", (x, text)) for x in ("user", "assistant")]
            options.append([(4, "D", None), *stay])
        for edits in itertools.product(*options):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit = cost + 3 * len(inserted[k]), audit + "I" * len(inserted[k])
                out += [(x, "") for x in inserted[k]]
                if k < len(rows):
                    cost, audit = cost + edits[k][0], audit + edits[k][1]
                    out += [edits[k][2]] if edits[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                yield cost, audit, out


def _dynamic(rows, faults):
    """Least (cost, audit, repaired rows) by rows and letters so far."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(labels):
        for _ in range(3):
            for last, (c, a, o) in list(labels.items()):
                for x in nexts[last]:
                    if x != "s":
                        new = (c + 3, a + "I", [*o, ({"u": "user", "a": "assistant"}[x], "")])
                        labels[x] = min(labels.get(x, new), new, key=lambda y: y[:2])
        return labels

    labels = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(last, label, new=new):
            if last not in new or label[:2] < new[last][:2]:
                new[last] = label

        for last, (c, a, o) in labels.items():
            offer(last, (c + 4, a + "D", o))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in nexts[last]:
                    offer(role[:1], (c + more, a + "K", [*o, (role, text)]))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in nexts[last]:
                        offer(x, (c + 3 + more, a + "R", [*o, (name, text)]))
        labels = inserted(new)
    return min((labels[x] for x in ("", "a") if x in labels), key=lambda y: y[:2])


def _plain(original, damaged):
    out = []
    for conv in {c for c, *_ in original}:
        rows = sorted(((t is not None, t or 0, r, x) for c, t, r, x in damaged if c == conv))
        turns = {t for known, t, *_ in rows if known}
        rows_ = [(r, x) for *_, r, x in rows]
        faults = _faults(rows_)
        initials = [r[:1] for r, _ in rows_]
        cost, audit, fixed = _dynamic(rows_, faults)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def _rows(seed, convs=30, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut", " spaced. \n", "", " \t", "a.b", "Hm.", "Yes.", "long " * 20 + "."]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, t + 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "ann"]), rng.choice([*texts, None])))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (convs, None, None, None)] + rows[:3]


def _got(frame, **kw):
    return sorted((tuple(r) for r in cr.repair(cr.damage(frame), **kw).select(*COUNTS).collect()), key=repr)


@pytest.mark.parametrize("fragment", [None, 1, 3])
def test_repair(spark, fragment):
    rows = _rows(1)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ROWS).repartition(3)
    assert _got(frame, fragment=fragment) == _plain(rows, list(_damaged(rows)))


@pytest.mark.parametrize("fragment", [None, 7])
def test_one_conversation_of_many_rows(spark, fragment):
    """A conversation longer than a fragment, spread over tasks, equals one solved whole."""
    rng = random.Random(2)
    rows = [(5, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No!", "cut", f"text {t}.", ""])) for t in range(700)]
    rows += [(c, 0, "user", "Hi.") for c in range(5)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ROWS).repartition(5)
    assert _got(frame, fragment=fragment) == _plain(rows, list(_damaged(rows)))


def test_repaired_rows(spark):
    rows = _rows(3)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    for fragment in (None, 2):
        for r in cr.repair(cr.damage(frame), fragment, texts=True).collect():
            fixed = [(x.role, x.text) for x in r.repaired]
            assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in fixed))
            assert hashlib.sha256(cr.render(fixed).encode()).hexdigest() == r.repaired_sha256


def test_equal_rows_are_counted(spark):
    """Copies of one row by the thousand are one row with a count."""
    rows = [(1, 3, "user", "Same.")] * 3000 + [(1, 4, "assistant", "End.")] + [(1, 5, "user", " ")] * 500
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies long")
    got = cr.repair(frame).first()
    assert (got.blank, got.duplicate, got.truncated, got.gaps) == (500, 2999, 0, 0)
    assert got.cost == 4 * 3499 and got.audit == "K" + "D" * 2999 + "K" + "D" * 500 and got.illegal == 2999 + 499


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["", "cut", "A.", "B!", "C?"])), max_size=9))
def test_search_equals_the_dynamic_program(rows):
    faults = _faults(rows)
    items = [cr.Item(None) if f in ("blank", "duplicate") else cr.Item(r[:1], f == "truncated") for (r, _), f in zip(rows, faults, strict=True)]
    cost, audit, fixed = _dynamic(rows, faults)
    assert cr.cheapest(items) == (cost, audit)
    assert cr.apply_audit(rows, audit) == fixed


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.sampled_from(["", "cut", "A."])), max_size=3))
def test_dynamic_program_equals_all_sequences(rows):
    faults = _faults(rows)
    want = min(_sequences(rows, faults), key=lambda x: x[:2])
    assert _dynamic(rows, faults)[:2] == want[:2] and _dynamic(rows, faults)[2] == want[2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*(cr.Item(x, t) for x in "sua" for t in (False, True)), cr.Item(None), cr.Item(None, n=3), cr.Item("t")]), max_size=24), st.lists(st.integers(0, 24), max_size=4))
def test_folded_fragments_equal_the_whole(items, cuts):
    fold, bounds = cr.Fold(), sorted({0, len(items), *(c for c in cuts if c < len(items))})
    pieces = [items[a:z] for a, z in itertools.pairwise(bounds)] or [[]]
    paths = [{(a, b): got for a in range(4) for b in range(4) if (got := cr.cheapest(p, a, (b,)))} for p in pieces]
    for p in paths:
        fold.add([{"before": a, "after": b, "cost": c, "audit": t} for (a, b), (c, t) in p.items()])
    ways = fold.ways()
    assert (sum(p[w][0] for p, w in zip(paths, ways, strict=True)), "".join(p[w][1] for p, w in zip(paths, ways, strict=True))) == cr.cheapest(items)


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], ROWS)
    assert cr.repair(cr.damage(empty)).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 2_000_000 + "."), (2, 0, "user", "z")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    assert _got(frame) == _plain(rows, list(_damaged(rows)))


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Hi.", "x"), (conv, 0, "assistant", "Ho.", "x")], ROWS)
    assert _got(frame) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.damage(frame).agg(F.sum("copies")).first()[0] == 0
