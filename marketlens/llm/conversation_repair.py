"""Repairing the turn structure of conversations by the cheapest edits.

A repaired conversation is empty, or an optional system row followed by user and assistant rows in turn. Rows are kept,
given another role, deleted or inserted at fixed costs. A conversation is a lattice: nodes are (rows consumed, state of the
pattern), edges are edits. A forward search from its start and a reverse search from its ends grow by Dijkstra's rule until
their tops together exceed the cheapest meeting, so all meetings of that cost are known; of these the least audit (the
edits' initials in order) is taken. At one node, prefixes of the same cost never are prefixes of one another, and neither
are suffixes, so the least whole audit is made of a least prefix and a least suffix.

Rows are sorted by range of (conversation, turn), so a long conversation is spread over tasks. A task reads its range as a
stream. A conversation that lies inside it, and is short, is solved at once; others are cut into fragments of at most
``FRAGMENT`` rows, each solved for every pair of states before and after it, and the fragments of a conversation are
folded in order, keeping four labels. Only the hash of the repaired text must see a whole conversation, as a stream.

Defined cases: a null conv_id is one conversation; a null turn comes first; a null role or text is one space; an empty
role has no initial and can't be kept; rows of one turn are ordered by role, then text; equal rows of a turn are one with a
count; a conversation without rows after damage costs nothing; an empty table gives no rows; a very long text is
read whole, and a fragment ends early at ``FRAGMENT_BYTES``; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import modest_batches, tidy, written

#: Costs of the edits: keep is free; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text after which a conversation is cut into fragments.
FRAGMENT, FRAGMENT_BYTES = 1024, 1 << 20

#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_ENDS = (START, ASSISTANT)
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
_NAMES = {"u": "user", "a": "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies``: rows damaged by the checksum of ``conv_id:turn``. A dropped row stays
    with no copies, so its conversation is still known."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("_kind")
    return plain.withColumn("_kind", F.crc32(key.cast("binary")) % 20).select(
        "conv_id",
        "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


@dataclass(slots=True)
class Item:
    """A row that may stay (``initial``, ``truncated``), or a run of ``n`` rows that must go (initial None)."""

    initial: str | None
    truncated: bool = False
    n: int = 1


def _edits(item: Item, state: int) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, initials) of the edits that consume the item."""
    yield state, DELETE * item.n, "D" * item.n
    if item.initial is None:
        return
    more = TRUNCATED * item.truncated
    if (to := _NEXT.get((state, item.initial))) is not None:
        yield to, more, "K"
    for letter in _NAMES:
        if (to := _NEXT.get((state, letter))) is not None:
            yield to, REROLE + more, "R"


_INSERTS = {s: [to for letter in _NAMES if (to := _NEXT.get((s, letter))) is not None] for s in _STATES}


def cheapest(items: list[Item], start: int = START, ends: Iterable[int] = _ENDS) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from a state before the items to one of ``ends`` after them."""
    n = len(items)
    back: list[dict] = []  # by item and state after it: (state before, cost, initials)
    for item in items:
        into: dict[int, list] = {s: [] for s in _STATES}
        for s in _STATES:
            for to, cost, initials in _edits(item, s):
                into[to].append((s, cost, initials))
        back.append(into)
    inserted_from = {s: [b for b in _STATES if s in _INSERTS[b]] for s in _STATES}

    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str]] = {}
    # equal costs: forward nearest the start first, reverse nearest the end first, so a free edge's source comes first
    fore: list = []
    rear: list = []
    best = None

    def reach(mine: dict, other: dict, heap: list, order: int, node: tuple[int, int], label: tuple[int, str]) -> None:
        nonlocal best
        if node in mine and mine[node] <= label:
            return
        mine[node] = label
        heapq.heappush(heap, (label[0], order * node[0], label[1], node))
        if node in other and (best is None or label[0] + other[node][0] < best):
            best = label[0] + other[node][0]

    reach(ahead, behind, fore, 1, (0, start), (0, ""))
    for s in ends:
        reach(behind, ahead, rear, -1, (n, s), (0, ""))
    while fore and rear and (best is None or fore[0][0] + rear[0][0] <= best):
        if fore[0][0] <= rear[0][0]:
            cost, _, audit, node = heapq.heappop(fore)
            if ahead[node] != (cost, audit):
                continue
            i, s = node
            for to in _INSERTS[s]:
                reach(ahead, behind, fore, 1, (i, to), (cost + INSERT, audit + "I"))
            if i < n:
                for to, more, initials in _edits(items[i], s):
                    reach(ahead, behind, fore, 1, (i + 1, to), (cost + more, audit + initials))
        else:
            cost, _, audit, node = heapq.heappop(rear)
            if behind[node] != (cost, audit):
                continue
            i, s = node
            for before in inserted_from[s]:
                reach(behind, ahead, rear, -1, (i, before), (cost + INSERT, "I" + audit))
            if i:
                for before, more, initials in back[i - 1][s]:
                    reach(behind, ahead, rear, -1, (i - 1, before), (cost + more, initials + audit))
    if best is None:
        return None
    few, many = sorted((ahead, behind), key=len)
    return best, min(ahead[x][1] + behind[x][1] for x in few if x in many and ahead[x][0] + behind[x][0] == best)


def apply_audit(rows: list[tuple[str, str]], audit: str, letter: str = "u") -> list[tuple[str, str]]:
    """The repaired (role, text) rows. The audit settles all roles: a row kept as "s" is the system row, and the others
    take turns, beginning with ``letter``."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
        elif edit == "I":
            out.append((_NAMES[letter], ""))
            letter = "a" if letter == "u" else "u"
        else:
            role, text = rows[at]
            at += 1
            if edit == "K" and role[:1] == "s":
                out.append((role, text))
                continue
            out.append((role if edit == "K" else _NAMES[letter], text))
            letter = "a" if letter == "u" else "u"
    return out


@dataclass
class Fragment:
    """Consecutive rows of one conversation: (turn, role, text, copies, seen before)."""

    conv: int | None
    rows: list = field(default_factory=list)
    size: int = 0

    def solve(self) -> None:
        self.items: list[Item] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        turns = [t for t, *_ in self.rows if t is not None]
        self.turns = (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)
        for _, role, text, n, seen in self.rows:
            initial = role[:1]
            self.illegal += n - 1 + (self.last is not None and self.last + initial not in _LEGAL)
            self.first = initial if self.first is None else self.first
            self.last = initial
            solid = text.rstrip(_SPACE)
            if not solid:
                self.blank += n
                self._forced(n)
                continue
            again = n if seen else n - 1
            self.duplicate += again
            if not seen:
                cut = solid[-1] not in ".!?"
                self.truncated += cut
                self.items.append(Item(initial, cut))
            self._forced(again)

    def _forced(self, n: int) -> None:
        if n and self.items and self.items[-1].initial is None:
            self.items[-1].n += n
        elif n:
            self.items.append(Item(None, n=n))

    def copies(self) -> list[tuple[str, str]]:
        return [(role, text) for _, role, text, n, _ in self.rows for _ in range(n)]

    def stats(self) -> dict:
        return {"min_turn": self.turns[0], "max_turn": self.turns[1], "n_turns": self.turns[2], "first": self.first, "last": self.last, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def render(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


_STATS = [(x, pa.int64()) for x in ("min_turn", "max_turn", "n_turns")] + [("first", pa.string()), ("last", pa.string())] + [(x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal")]
_PATHS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), *_STATS, ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _ROWS), ("sha", pa.string()), ("paths", _PATHS), ("copies", _ROWS)])
_PARTS_SQL = "conv_id long, seq long, whole boolean, min_turn long, max_turn long, n_turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role string, text string>>, sha string, paths array<struct<before int, after int, cost long, audit string>>, copies array<struct<role string, text string>>"


def _listed(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in rows]


def parts(rows: DataFrame, fragment: int | None = None, texts: bool = False) -> DataFrame:
    """One row a short conversation, solved, and one a fragment of the others. ``texts``: give repaired rows, too."""
    fragment = fragment or FRAGMENT
    modest_batches(rows.sparkSession)
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    placed = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    text_hash = F.xxhash64("text")
    first = counted.where("n > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), text_hash.alias("_hash")).agg(F.min(placed).alias("_first"))
    seen = counted.withColumn("hash", text_hash).join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash")), "left")
    seen = seen.select("conv_id", "turn", "role", "text", "n", F.coalesce(F.col("_first") < placed, F.lit(False)).alias("seen"), "hash")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    spread = seen.repartitionByRange(*order, F.col("hash")).sortWithinPartitions(*order, F.col("text")).drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        out: list[dict] = []
        now: Fragment | None = None
        alone = False  # the conversation surely began in this task, and no fragment of it is out yet
        held = 0

        def end(whole: bool) -> None:
            nonlocal place, held
            now.rows = [r for r in now.rows if r[3]]
            now.solve()
            row = {"conv_id": now.conv, "seq": place, "whole": whole, **now.stats(), "cost": None, "audit": None, "repaired": None, "sha": None, "paths": None, "copies": None}
            place += 1
            if whole:
                row["cost"], row["audit"] = cheapest(now.items)
                fixed = apply_audit(now.copies(), row["audit"])
                row["sha"] = hashlib.sha256(render(fixed).encode()).hexdigest()
                row["repaired"] = _listed(fixed) if texts else None
            else:
                row["paths"] = [{"before": a, "after": b, "cost": got[0], "audit": got[1]} for a in _STATES for b in _STATES if (got := cheapest(now.items, a, (b,)))]
                row["copies"] = _listed(now.copies())
            out.append(row)
            held += now.size

        for b in batches:
            for conv, turn, role, text, n, seen_before in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now is not None and conv != now.conv:
                    end(alone)
                    now, alone = Fragment(conv), True
                elif now is None:
                    now = Fragment(conv)
                elif len(now.rows) >= fragment or now.size >= FRAGMENT_BYTES:
                    end(False)
                    now, alone = Fragment(conv), False
                now.rows.append((turn, role, text, n, seen_before))
                now.size += len(text)
                if len(out) >= 512 or held >= 8 * FRAGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_PARTS)
                    out, held = [], 0
        if now is not None:
            end(False)  # it may go on in the next task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    return spread.mapInArrow(tidy(run), _PARTS_SQL)


class Fold:
    """Labels of the four states after some fragments. A label's audit stands as a short text that compares with the others',
    however both go on, as the audits themselves do."""

    def __init__(self):
        self.labels = {START: (0, "")}
        self.choices: list[dict[int, int]] = []

    def add(self, paths: list[dict]) -> None:
        new: dict[int, tuple[int, str]] = {}
        came: dict[int, int] = {}
        for p in paths:
            if p["before"] in self.labels:
                cost, audit = self.labels[p["before"]]
                label = (cost + p["cost"], audit + p["audit"])
                if p["after"] not in new or label < new[p["after"]]:
                    new[p["after"]], came[p["after"]] = label, p["before"]
        self.choices.append(came)
        short: dict[str, str] = {}
        for k, audit in enumerate(sorted({a for _, a in new.values()})):
            stem = max((x for x in short if audit.startswith(x)), key=len, default=None)
            short[audit] = chr(ord("a") + k) if stem is None else short[stem] + audit[len(stem) :]
        self.labels = {s: (cost, short[audit]) for s, (cost, audit) in new.items()}

    def ways(self) -> list[tuple[int, int]]:
        """(state before, state after) of each fragment on the cheapest way."""
        state = min((s for s in _ENDS if s in self.labels), key=lambda s: self.labels[s])
        out = []
        for came in reversed(self.choices):
            out.append((came[state], state))
            state = came[state]
        return out[::-1]


def _by_conversation(frame: DataFrame) -> DataFrame:
    return frame.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")


def _joined(fragments: DataFrame, texts: bool) -> DataFrame:
    """The fragments' conversations: a fold chooses each fragment's way, fragments are repaired, and their texts hashed in order."""
    way = pa.schema([("of", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv, seqs = None, None, []
        for b in batches:
            for c, seq, paths in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if fold is None or c != conv:
                    if fold:
                        yield from ended(fold, seqs)
                    fold, conv, seqs = Fold(), c, []
                fold.add(paths)
                seqs.append(seq)
        if fold:
            yield from ended(fold, seqs)

    def ended(fold: Fold, seqs: list[int]) -> Iterator[pa.RecordBatch]:
        ways = fold.ways()
        yield pa.RecordBatch.from_pydict({"of": seqs, "before": [a for a, _ in ways], "after": [b for _, b in ways]}, schema=way)

    ways = _by_conversation(fragments.select("conv_id", "seq", "paths")).mapInArrow(tidy(choose), "of long, before int, after int")
    stats = [x for x, _ in _STATS]
    chosen = fragments.join(ways, F.col("seq") == F.col("of")).withColumn("path", F.expr("filter(paths, p -> p.before = before AND p.after = after)[0]"))
    chosen = chosen.select("conv_id", "seq", *stats, F.col("path.cost").alias("cost"), F.col("path.audit").alias("audit"), "before", "copies")
    schema = pa.schema([_PARTS.field(x) for x in ("conv_id", *stats, "cost", "audit", "repaired", "sha")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        audits: list[str] = []
        digest, lines, fixed_rows, turn = None, 0, [], None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([now | {"audit": "".join(audits), "sha": digest.hexdigest(), "repaired": _listed(fixed_rows) if texts else None}], schema=schema)

        for b in batches:
            for row in b.to_pylist():
                conv, before, audit, copies = row["conv_id"], row.pop("before"), row.pop("audit"), row.pop("copies")
                row.pop("seq")
                if now is None or conv != now["conv_id"]:
                    if now is not None:
                        yield ended()
                    now, audits, digest, lines, fixed_rows, turn = None, [], hashlib.sha256(), 0, [], None
                fixed = apply_audit([(x["role"], x["text"]) for x in copies], audit, "a" if before == USER else "u")
                if fixed:
                    digest.update((("\n" if lines else "") + render(fixed)).encode())
                    lines += len(fixed)
                audits.append(audit)
                if texts:
                    fixed_rows += fixed
                if now is None:
                    now = row
                else:
                    if row["first"] is not None:
                        now["illegal"] += now["last"] is not None and now["last"] + row["first"] not in _LEGAL
                        now["first"] = row["first"] if now["first"] is None else now["first"]
                        now["last"] = row["last"]
                    now["n_turns"] += row["n_turns"] - (row["min_turn"] is not None and row["min_turn"] == turn)
                    now["min_turn"] = row["min_turn"] if now["min_turn"] is None else now["min_turn"]
                    now["max_turn"] = now["max_turn"] if row["max_turn"] is None else row["max_turn"]
                    for x in ("blank", "duplicate", "truncated", "illegal", "cost"):
                        now[x] += row[x]
                turn = now["max_turn"]
        if now is not None:
            yield ended()

    names = {"cost": "cost long", "audit": "audit string", "repaired": "repaired array<struct<role string, text string>>", "sha": "sha string", "first": "first string", "last": "last string"}
    return _by_conversation(chosen).mapInArrow(tidy(join), ", ".join(names.get(f.name, f"{f.name} long") for f in schema))


def repair(rows: DataFrame, fragment: int | None = None, texts: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation; with
    ``texts`` also ``repaired``, its rows. ``rows`` has conv_id, turn, role, text and copies (see ``damage``)."""
    found = written(parts(rows, fragment, texts), "conversations")
    one = ["conv_id", *[x for x, _ in _STATS], "cost", "audit", "repaired", "sha"]
    every = found.where("whole").select(*one).unionByName(_joined(found.where("NOT whole"), texts).select(*one))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    out = every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"), "repaired")
    return out if texts else out.drop("repaired")
