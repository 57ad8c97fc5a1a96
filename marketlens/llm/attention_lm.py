"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

The model is one layer of causal attention over subword ids with a bias by distance, a hidden layer, and a two-step
output: a class of ids, then the id within its class (49,409 ids and 32 classes make a full softmax needless). A text
is scored in overlapping windows: a window holds CONTEXT positions for context and SCORED positions that are scored, so
each token is scored once; windows go through masked attention in batches, and never look into another document.

Counts of the pairs and triples of ids of all training documents lie above the attention model: where a context of one
or two ids was seen, its counted continuations take their discounted share, and what is left goes to the shorter
context and at last to the attention model, so that the whole is one distribution. The ``MEMORY`` most frequent pairs,
triples and contexts (a fixed bound) are broadcast and serve most tokens; every other token meets the counts of its own
pair, triple and context in joins, so none is left out, however rare.

The model is fitted on every training document. Texts are cut to ids once and written. Counts of ids, which set the
ids' own vectors, their shares within a class and the classes' bias, and counts of neighbours, from which the classes
come, are added up by Spark over all tasks. Then the documents are dealt out by hash in rounds and shards: in a round
each shard descends from the same parameters over all of its windows, and the shards' parameters are averaged. So each
position of each training document is learned from once; shards descend side by side, so the work grows with the corpus, but not the number of steps one after another; a corpus of
less than ``STEPS * WINDOWS`` windows is gone through several times.

The shuffle of pairs and triples, like that of the words, grows with the corpus; the model that comes of it does not.

The base score needs every word's count over all training documents. Counts are gathered by a shuffle that grows with
the corpus. The ``TOP_WORDS`` most frequent words (a fixed bound) are broadcast and cover most tokens; all other words
meet their counts in a join, so no count is left out.

Defined cases: a null text is empty: its only token is the end. A null doc_id is held out. Without training documents
N, V and every count are 0 and the model is uniform within its classes. Repeated rows are scored, and counted, each
time. An empty table gives no rows. A very long text is cut into as many windows as it has, and scored whole. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import text as tx
from marketlens.llm.language_id import in_fold
from marketlens.llm.subwords import Encoder
from marketlens.llm.tables import modest_batches, most_frequent, record_batch, shuffles_freed, tidy, written, written_meanwhile

VOCABULARY = "word_bpe_49k.json"
IDS = 49_409  # the vocabulary's ids and the end
END = IDS - 1
TOP_WORDS = 1 << 17
#: Ids with vectors of their own; the others share one.
OWN_IDS = 4095
CLASSES, WIDTH, HIDDEN, CONTEXT, SCORED = 32, 8, 16, 8, 16
STEPS, WINDOWS, RATE = 200, 256, 0.01
#: Most frequent pairs, triples and contexts of ids that are broadcast; what each count gives up to shorter contexts.
MEMORY, DISCOUNT = 1 << 19, 0.7
#: Ids of a shard, about, and rounds after which shards are averaged.
SHARD_IDS, ROUNDS = 1 << 20, 4
#: Ids whose pairs and triples a task gathers before it passes their counts on.
COUNTED = 1 << 21
#: Ids of which a task makes contexts at once.
PORTION = 1 << 18
#: Most frequent ids that count as neighbours, on either side.
NEIGHBOURS = 128
#: Key of the end token among the word hashes.
END_KEY = np.uint64(0x5E17E2D5)


# ---- the model ----


@dataclass
class Places:
    """Different numbers in the order of their hashes, and where each hash begins: a number is found in a look or two."""

    numbers: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, numbers: np.ndarray) -> tuple[Places, np.ndarray]:
        """Besides, the order in which the numbers are kept."""
        hashes = _hashes(numbers, bits := numbers.size.bit_length() + 1)
        by = np.argsort(hashes, kind="stable")
        return cls(numbers[by], np.searchsorted(hashes[by], np.arange((1 << bits) + 1)).astype(np.int32)), by

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each wanted number stands, and whether it is there."""
        if not self.numbers.size:
            return np.zeros(wanted.size, np.int32), np.zeros(wanted.size, bool)
        hashes = _hashes(wanted, (self.begins.size - 1).bit_length() - 1)
        at, end = self.begins.take(hashes), self.begins.take(hashes + 1)
        np.minimum(at, self.numbers.size - 1, out=at)
        hit = self.numbers.take(at) == wanted
        left = np.flatnonzero(~hit & (at + 1 < end))
        while left.size:  # as often as the fullest hash has numbers
            at[left] += 1
            hit[left] = self.numbers.take(at[left]) == wanted[left]
            left = left[~hit[left] & (at[left] + 1 < end[left])]
        return at, hit


def _hashes(numbers: np.ndarray, bits: int) -> np.ndarray:
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Memory:
    """Continuations of contexts of one length: keys (context, then id) with their shares, and contexts with what each
    leaves to shorter ones and how often it came before anything. Whether these are all keys, and all contexts."""

    keys: Places
    shares: np.ndarray
    contexts: Places
    rests: np.ndarray
    totals: np.ndarray
    all_keys: bool
    all_contexts: bool

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray, distinct: np.ndarray, all_keys: bool, all_contexts: bool) -> Memory:
        """From keys, how often each came, contexts, how often each came, and how many continuations each has. A key
        whose context is not among the contexts is not kept."""
        of, by = Places.of(contexts)
        totals, distinct = totals[by], distinct[by]
        at, hit = of.find(keys // IDS)
        kept, by = Places.of(keys[hit])
        shares = (counts[hit] - DISCOUNT) / totals[at[hit]]
        return cls(kept, shares[by], of, DISCOUNT * distinct / totals, totals.astype(np.float64), all_keys and bool(hit.all()), all_contexts)

    def find(self, contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each id after its context, and what the context leaves, by what is kept."""
        return self.look(contexts, ids)[:2]

    def look(self, contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Besides, how often the context came (1 where it is not kept), whether the share is sure, and whether the rest is."""
        at, seen = self.contexts.find(contexts)
        rests, totals = (np.where(seen, x.take(at), 1.0) if x.size else np.ones(at.size) for x in (self.rests, self.totals))
        at, hit = self.keys.find(contexts * IDS + ids)
        shares = np.where(hit, self.shares.take(at), 0.0) if self.shares.size else np.zeros(at.size)
        sure_rest = seen | self.all_contexts
        return shares, rests, totals, hit | self.all_keys | (~seen & self.all_contexts), sure_rest


def _found(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands, and whether it is there."""
    if not sorted_.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), sorted_.size - 1)
    return at, sorted_[at] == wanted


@dataclass
class Open:
    """Tokens whose probability needs counts that are not kept. ``doc``, ``key``, ``left``: only the triple's count n is
    missing; n less the discount (0 if there is none), and ``left``, are the factor of the probability that is missing.
    ``pair_*``: the counts of the pair, or of the context of two, are missing as well: the pair's count less the discount,
    and ``pair_left``, by ``pair_total``, make the probability after one id."""

    doc: np.ndarray
    key: np.ndarray
    left: np.ndarray
    pair_doc: np.ndarray
    pair_key: np.ndarray
    pair_left: np.ndarray
    pair_total: np.ndarray


def _contexts(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each position of a stream but the first: the id, the one before, and both before it as one number. What lies
    before a document is the end."""
    before = stream[:-1]
    earlier = np.where(before == END, END, np.concatenate([[END], stream[:-2]]))
    return stream[1:], before, earlier * IDS + before


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and triples of all rows (ids) as size, key, n; and the contexts as size, context, total, distinct.
    Tasks count their own rows first."""
    schema = pa.schema([("size", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {2: [], 3: []}

        def counted() -> Iterator[pa.RecordBatch]:
            for size, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                yield record_batch(schema, np.full(keys.size, size, np.int32), keys, n)

        waiting = 0
        for b in batches:
            for part in _portions(b.column(0)):
                ids, one, two = _contexts(_stream(*_listed(part))[0])
                held[2].append(one * IDS + ids)
                held[3].append(two * IDS + ids)
                waiting += ids.size
                if waiting > COUNTED:
                    yield from counted()
                    waiting = 0
        if waiting:
            yield from counted()

    found = rows.select("ids").mapInArrow(tidy(run), "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
    found = written(found, "memory", "zstd")
    of = found.select("size", F.expr(f"key div {IDS}").alias("context"), "n")
    return found, written(of.groupBy("size", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")), "contexts")


def _memories(found: DataFrame, contexts: DataFrame) -> tuple[Memory, Memory]:
    """The most frequent pairs and triples. The contexts of pairs are ids, so all of them are kept."""
    many = {(k, r.size): r.n for k, df in (("key", found), ("context", contexts)) for r in df.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for size in (2, 3):
        own = most_frequent(found.where(F.col("size") == size).select("key", "n"), "n", "key", MEMORY).toArrow()
        of = contexts.where(F.col("size") == size).select("context", "total", "distinct")
        of = (of if size == 2 else most_frequent(of, "total", "context", MEMORY)).toArrow()
        columns = [*(own[c].to_numpy() for c in ("key", "n")), *(of[c].to_numpy() for c in ("context", "total", "distinct"))]
        out.append(Memory.of(*columns, own.num_rows == many.get(("key", size), 0), of.num_rows == many.get(("context", size), 0)))
    return out[0], out[1]


@dataclass
class Model:
    place: np.ndarray  # id to row of the tables
    group: np.ndarray  # id to class
    inside: np.ndarray  # id to log10 of its share in the class
    p: dict[str, np.ndarray]
    memories: tuple[Memory, ...] = ()  # of pairs and triples

    def table(self) -> np.ndarray:
        """For each row of the ids' vectors its query, key, value with a one, and hidden input, side by side."""
        e, p = self.p["e"], self.p
        return np.concatenate([e @ p["q"] / np.sqrt(WIDTH), e @ p["k"], e @ p["v"], np.ones((len(e), 1)), e @ p["hx"] + p["hb"]], axis=1).astype(np.float32)


_DISTANCE = (np.arange(CONTEXT, CONTEXT + SCORED)[:, None] - np.arange(CONTEXT + SCORED)[None, :]).clip(-1)


def _parameters(rows: int, rng) -> dict[str, np.ndarray]:
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    return {"e": rng.normal(0, 0.3, (rows, WIDTH)).astype(np.float32), "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH), "d": np.zeros(CONTEXT + SCORED, np.float32), "hx": normal(WIDTH, HIDDEN), "ho": normal(WIDTH, HIDDEN), "hb": np.zeros(HIDDEN, np.float32), "w": normal(HIDDEN, CLASSES), "b": np.zeros(CLASSES, np.float32)}


def _loss(p: dict, rows: np.ndarray, allowed: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy of the classes and its gradients, for windows of rows (B, CONTEXT + SCORED)."""
    flat = lambda x: x.reshape(-1, x.shape[-1])
    x = p["e"][rows]
    xq = x[:, CONTEXT:]
    fx, fq = flat(x), np.ascontiguousarray(xq).reshape(-1, WIDTH)
    q = (fq @ (p["q"] / np.float32(np.sqrt(WIDTH)))).reshape(xq.shape)
    k, v = (fx @ p["k"]).reshape(x.shape), (fx @ p["v"]).reshape(x.shape)
    att = np.matmul(q, k.transpose(0, 2, 1))
    att += p["d"][_DISTANCE.clip(0)]
    np.clip(att, -60, 60, out=att)
    np.exp(att, out=att)
    att *= allowed
    att /= att.sum(-1, keepdims=True)
    o = flat(att @ v)
    h = fq @ p["hx"]
    h += o @ p["ho"]
    h += p["hb"]
    np.maximum(h, 0, out=h)
    y = h @ p["w"]
    y += p["b"]
    y -= y.max(1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(1, keepdims=True)
    n = target.size
    at = np.arange(n), target.ravel()
    loss = float(-np.log(y[at] + 1e-12).mean())
    y[at] -= 1
    y /= np.float32(n)
    g = {"w": h.T @ y, "b": y.sum(0)}
    dz = y @ p["w"].T
    dz *= h > 0
    g |= {"hx": fq.T @ dz, "ho": o.T @ dz, "hb": dz.sum(0)}
    do = (dz @ p["ho"].T).reshape(xq.shape)
    da = do @ v.transpose(0, 2, 1)
    dv = att.transpose(0, 2, 1) @ do
    da -= np.einsum("bij,bij->bi", da, att)[..., None]
    da *= att
    g["d"] = np.bincount(_DISTANCE.clip(0).ravel(), weights=da.sum(0).ravel(), minlength=CONTEXT + SCORED).astype(np.float32)
    dq, dk = flat(da @ k), flat(da.transpose(0, 2, 1) @ q)
    dv = flat(dv)
    dq /= np.float32(np.sqrt(WIDTH))
    g |= {"q": fq.T @ dq, "k": fx.T @ dk, "v": fx.T @ dv}
    dx = dk @ p["k"].T
    dx += dv @ p["v"].T
    dx.reshape(x.shape)[:, CONTEXT:] += (dq @ p["q"].T + dz @ p["hx"].T).reshape(xq.shape)
    fr = rows.ravel()
    g["e"] = np.stack([np.bincount(fr, weights=dx[:, j], minlength=len(p["e"])) for j in range(WIDTH)], axis=1).astype(np.float32)
    return loss, g


def _windows(stream: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of windows whose scored part starts at ``first``; before the stream's start it is position 0."""
    return (first[:, None] + np.arange(-CONTEXT, SCORED)).clip(0, stream.size - 1)


def _allowed(pos: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Causal, within the document, and not before the stream's start."""
    real = first[:, None] + np.arange(-CONTEXT, SCORED) >= 0
    of = doc[pos]
    return (_DISTANCE >= 0) & real[:, None, :] & (of[:, None, :] == of[:, CONTEXT:, None])


def _stream(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another with the end before, between and after them, and each position's document."""
    n, size = len(bounds) - 1, np.diff(bounds)
    stream = np.full(int(size.sum()) + n + 1, END, np.int64)
    stream[np.arange(int(size.sum())) + np.repeat(np.arange(n), size) + 1] = ids
    return stream, np.append(np.repeat(np.arange(n), size + 1), n)


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each id, the rare ids sharing the last, and how often each row comes."""
    own = np.argsort(-counts, kind="stable")[:OWN_IDS]
    own = own[counts[own] > 1]
    if END not in own:
        own = np.append(own, END)
    place = np.full(IDS, len(own))
    place[own] = np.arange(len(own))
    return place, np.bincount(place, weights=counts, minlength=len(own) + 1).astype(np.int64)


def _columns(row_counts: np.ndarray) -> np.ndarray:
    """Column of each row that counts as a neighbour, or -1."""
    common = np.argsort(-row_counts, kind="stable")[:NEIGHBOURS]
    column = np.full(row_counts.size, -1)
    column[common] = np.arange(common.size)
    return column


def _neighbours(seen: np.ndarray, column: np.ndarray) -> np.ndarray:
    """How often each row has each neighbour after and before it, as one array."""
    out = np.zeros(column.size * 2 * NEIGHBOURS, np.int64)
    for a, b, shift in ((seen[:-1], seen[1:], 0), (seen[1:], seen[:-1], NEIGHBOURS)):
        ok = column[b] >= 0
        out += np.bincount(a[ok] * 2 * NEIGHBOURS + column[b[ok]] + shift, minlength=out.size)
    return out


def _groups(near: np.ndarray, counts: np.ndarray, rng) -> np.ndarray:
    """Classes of the rows by k-means over their neighbours; the last row, the rare ids, has the last class."""
    near = near.reshape(counts.size, -1)
    near = np.sqrt(near / np.maximum(1, near.sum(1, keepdims=True))).astype(np.float32)
    k = CLASSES - 1
    heavy = np.argsort(-counts[:-1], kind="stable")
    centres = near[heavy[np.linspace(0, max(0, min(len(heavy), 2000) - 1), k).astype(int)]] + rng.normal(0, 1e-3, (k, near.shape[1])).astype(np.float32)
    for _ in range(8):
        of = (near @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in np.unique(of):
            centres[c] = np.average(near[of == c], axis=0, weights=counts[of == c] + 1)
    of[-1] = k
    return of


def _begin(counts: np.ndarray, near: np.ndarray, seed: int) -> Model:
    """The model before any step, from counts of ids and of neighbours."""
    rng = np.random.default_rng(seed)
    place, row_counts = _places(counts)
    group = _groups(near, row_counts, rng)[place]
    weight = counts + np.where(place == row_counts.size - 1, 1.0, 0.01)
    inside = np.log10(weight / np.bincount(group, weights=weight, minlength=CLASSES)[group])
    p = _parameters(row_counts.size, rng)
    p["b"] = np.log(np.bincount(group, weights=counts, minlength=CLASSES) / max(1, counts.sum()) + 1e-4).astype(np.float32)
    return Model(place, group, inside, p)


class _Descent:
    """Adam from a model's parameters; ``expected`` steps of a training of which ``done`` and ``after`` are the shares
    gone through before and after them."""

    def __init__(self, model: Model, seed, expected: float, done: float = 0.0, after: float = 1.0):
        self.place, self.group, self.p = model.place, model.group, {k: v.copy() for k, v in model.p.items()}
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.rng, self.expected, self.done, self.after = np.random.default_rng(seed), expected, done, after
        self.t = self.windows = 0

    def run(self, stream: np.ndarray, doc: np.ndarray, times: int = 1) -> None:
        """Steps over all windows of the stream, so many times."""
        if stream.size < 2:
            return
        seen = self.place[stream]
        every = np.arange(0, stream.size - 1, SCORED)
        every[-1] = max(0, min(every[-1], stream.size - 1 - SCORED))
        self.windows += every.size
        for _ in range(times):
            order = self.rng.permutation(every)
            for lo in range(0, order.size, WINDOWS):
                first = order[lo : lo + WINDOWS]
                pos = _windows(stream, first)
                target = self.group[stream[np.minimum(pos[:, CONTEXT:] + 1, stream.size - 1)]]
                _, g = _loss(self.p, seen[pos], _allowed(pos, first, doc), target)
                self.t += 1
                t, gone = self.t, self.done + (self.after - self.done) * min(1.0, self.t / self.expected)
                rate = RATE * min(1, t / 30, 2 * (1 - gone) + 1e-3)
                for k, x in g.items():
                    m, v = self.moment[k]
                    m += 0.1 * (x - m)
                    v += 0.01 * (x * x - v)
                    self.p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def _times(ids: int, steps: int) -> int:
    """How often a corpus of so many ids is gone through, for so many steps at least."""
    return max(1, -(-steps * WINDOWS * SCORED // max(1, ids)))


def _expected(ids: float, times: int) -> float:
    return max(1.0, times * max(1.0, ids / SCORED / WINDOWS))


def train(sequences: list[np.ndarray], seed: int = 7, steps: int = STEPS) -> Model:
    """A model from documents' ids (without the end), in one process."""
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
    stream, doc = _stream(np.concatenate([np.zeros(0, np.int64), *sequences]), bounds)
    counts = np.bincount(stream[1:], minlength=IDS)
    place, row_counts = _places(counts)
    model = _begin(counts, _neighbours(place[stream], _columns(row_counts)), seed)
    times = _times(stream.size, steps)
    descent = _Descent(model, seed, _expected(stream.size, times))
    descent.run(stream, doc, times)
    return Model(model.place, model.group, model.inside, descent.p)  # attention alone


def score(model: Model, table: np.ndarray, ids: np.ndarray, bounds: np.ndarray, batch: int = 256) -> np.ndarray:
    """log10 probability of each document (its ids and the end) by what the model's memories keep."""
    return _parts(model, table, ids, bounds, batch, False)[0]


def _parts(model: Model, table: np.ndarray, ids: np.ndarray, bounds: np.ndarray, batch: int, leave_open: bool) -> tuple[np.ndarray, Open | None]:
    """log10 probability of each document, and with ``leave_open`` the tokens that need counts that are not kept: of these
    only the known factors are in it. A document's windows start at its first token, so its score does not depend on its
    neighbours; the end serves as what comes before the first token."""
    n = len(bounds) - 1
    size = np.diff(bounds) + 1  # tokens to score, the end among them
    windows = -(-size // SCORED)
    first = (np.cumsum(windows) - windows) * SCORED
    count = int(windows.sum())
    at = np.arange(ids.size) + np.repeat(first - bounds[:-1], size - 1)
    want = np.full(count * SCORED, END, dtype=np.int64)
    want[at] = ids
    seen = np.full(CONTEXT + count * SCORED, END, dtype=np.int64)
    seen[at + CONTEXT + 1] = ids  # a token's input is the one before it
    seen[first + CONTEXT] = END
    rows, target = model.place.take(seen), model.group.take(want)
    opening = np.zeros(count, bool)  # windows whose context lies before the document
    opening[first // SCORED] = True
    p = model.p
    weight = np.where(_DISTANCE >= 0, np.exp(p["d"][_DISTANCE.clip(0)]), 0).astype(np.float32)
    ones = np.ones(CLASSES, np.float32)
    logs = np.empty(want.size, np.float32)
    wide = CONTEXT + SCORED
    for lo in range(0, count, batch):
        hi = min(count, lo + batch)
        x = table.take(rows[lo * SCORED : hi * SCORED + CONTEXT], axis=0)
        # overlapping windows of the same rows, without copying them
        every = np.lib.stride_tricks.as_strided(x, (hi - lo, wide, x.shape[1]), (SCORED * x.strides[0], x.strides[0], x.strides[1]))
        s = np.matmul(every[:, CONTEXT:, :WIDTH], every[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1))
        np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= weight
        s[np.flatnonzero(opening[lo:hi]), :, :CONTEXT] = 0
        v = np.matmul(s, every[:, :, 2 * WIDTH : 3 * WIDTH + 1]).reshape(-1, WIDTH + 1)
        h = (v[:, :WIDTH] / v[:, WIDTH:]) @ p["ho"]
        h += x[CONTEXT:, 3 * WIDTH + 1 :]
        np.maximum(h, 0, out=h)
        y = h @ p["w"]
        y += p["b"]
        np.minimum(y, 60, out=y)
        got = y.ravel().take(np.arange(y.shape[0]) * CLASSES + target[lo * SCORED : hi * SCORED])
        np.exp(y, out=y)
        logs[lo * SCORED : hi * SCORED] = got - np.log(y @ ones)
    # the end may stand among the padding, but only positions up to it count
    real = np.arange(want.size) - np.repeat(first, windows * SCORED) < np.repeat(size, windows * SCORED)
    doc = np.repeat(np.arange(n), size)
    logs10 = logs[real] / np.log(10) + model.inside.take(want[real])
    if model.memories:
        share = 10.0**logs10
        target, one, two = _contexts(_stream(ids, bounds)[0])
        pairs, triples = model.memories
        own, rest, pair_total, sure, _ = pairs.look(one, target)
        own3, rest3, total, sure3, sure_rest = triples.look(two, target)
        left = rest * share
        share = own + left
        logs10 = np.log10(own3 + rest3 * share)
        if leave_open:
            deep = ~sure | ~sure_rest
            flat = np.flatnonzero(~deep & ~sure3)
            deep = np.flatnonzero(deep)
            logs10[flat] = -np.log10(total[flat])
            logs10[deep] = 0.0
            key = two * IDS + target
            found = Open(doc[flat], key[flat], (rest3 * share * total)[flat], doc[deep], key[deep], (left * pair_total)[deep], pair_total[deep])
            return np.bincount(doc, weights=logs10, minlength=n), found
    return np.bincount(doc, weights=logs10, minlength=n), None


def encoded(docs: DataFrame, training, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, training (a column of docs; a null text is no training document), h and ids of every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("training", pa.bool_()), ("h", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(1)):
                ids, bounds = encoder.ids(data, offsets)
                yield record_batch(schema, *(c.slice(lo, hi - lo) for c in b.columns), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (training & F.col("text").isNotNull()).alias("training"))
    return rows.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(tidy(run), "doc_id long, text string, training boolean, h long, ids array<int>")


def _listed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of lists."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    return col.flatten().to_numpy(), offsets - offsets[0]


def _portions(col: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column of lists: as many rows as hold no more than PORTION values, one at least."""
    ends, lo = col.offsets.to_numpy(), 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(ends, int(ends[lo]) + PORTION, side="right")) - 1)
        yield col.slice(lo, hi - lo)
        lo = hi


def _totals(rows: DataFrame, count, size: int) -> np.ndarray:
    """What ``count`` makes of each stream of ids, added up over all tasks. Only cells that are not zero are shuffled."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                total += count(_stream(*_listed(b.column(0)))[0])
        cells = np.flatnonzero(total)
        yield record_batch(schema, cells.astype(np.int32), total[cells])

    out = np.zeros(size, np.int64)
    found = rows.select("ids").mapInArrow(tidy(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def _round(rows: DataFrame, model: Model, shards: int, expected: float, times: int, done: float, after: float, seed: int) -> dict[str, np.ndarray]:
    """The parameters after each shard of rows (shard, h, ids) went through its windows, averaged by their number."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = sum(v.size for v in model.p.values())
    chunk = -(-size // 64)
    schema = pa.schema([("chunk", pa.int32()), ("shard", pa.int64()), ("windows", pa.int64()), ("part", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, descent, waiting, held = None, None, [], 0

        def learn() -> None:
            if waiting:
                descent.run(*_stream(*_listed(pa.concat_arrays(waiting))), times)

        def settled() -> Iterator[pa.RecordBatch]:
            learn()
            if descent is not None and descent.windows:
                flat = np.concatenate([v.ravel() for v in descent.p.values()])
                for c in range(-(-size // chunk)):
                    yield record_batch(schema, [c], [shard], [descent.windows], pa.array([flat[c * chunk : (c + 1) * chunk]], pa.list_(pa.float32())))

        for b in batches:
            of = b.column(0).to_numpy()
            cuts = [*np.flatnonzero(np.diff(of, prepend=of[:1] - 1)).tolist(), len(of)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if int(of[lo]) != shard:
                    yield from settled()
                    shard, waiting, held = int(of[lo]), [], 0
                    descent = _Descent(shared.value, (seed, shard), expected, done, after)
                waiting.append(b.column(1).slice(lo, hi - lo))
                held += len(waiting[-1].flatten()) + hi - lo
                if held > SHARD_IDS // 2:
                    learn()
                    waiting, held = [], 0
        yield from settled()

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        weight = table["windows"].to_numpy().astype(float)
        parts = table["part"].combine_chunks().flatten().to_numpy().reshape(len(weight), -1)
        return pa.table({"chunk": table["chunk"][:1], "part": pa.array([(weight @ parts / weight.sum()).astype(np.float32)], pa.list_(pa.float32()))})

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "ids")
    flat = np.concatenate([v.ravel() for v in model.p.values()])
    means = dealt.mapInArrow(tidy(run), "chunk int, shard long, windows long, part array<float>").groupBy("chunk").applyInArrow(mean, "chunk int, part array<float>")
    for row in means.toArrow().to_pylist():  # as large as the model
        flat[row["chunk"] * chunk : row["chunk"] * chunk + len(row["part"])] = row["part"]
    shared.destroy()
    ends = np.cumsum([v.size for v in model.p.values()])
    return {k: x.reshape(v.shape) for (k, v), x in zip(model.p.items(), np.split(flat, ends[:-1]), strict=True)}


def _fitted(rows: DataFrame, seed: int = 7) -> Model:
    """The attention of a model from all rows (h, ids)."""
    counts = _totals(rows, lambda stream: np.bincount(stream[1:], minlength=IDS), IDS)
    place, row_counts = _places(counts)
    column = _columns(row_counts)
    model = _begin(counts, _totals(rows, lambda stream: _neighbours(place[stream], column), column.size * 2 * NEIGHBOURS), seed)
    total = int(counts.sum())
    if not total:
        return model
    shards = -(-total // SHARD_IDS)
    rounds = ROUNDS if shards > 1 else 1
    times = _times(total, STEPS)
    expected = _expected(total / shards / rounds, times)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(shards))).withColumn("round", F.pmod(F.xxhash64(F.lit(2), "h"), F.lit(rounds)))
    for k in range(rounds):
        model.p = _round(dealt.where(F.col("round") == k), model, shards, expected, times, k / rounds, (k + 1) / rounds, seed + k)
    return model


def fit(training: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """A model from all rows (doc_id, text)."""
    rows = written(encoded(training, F.lit(True), vocabulary), "encoded").where("training")
    model = _fitted(rows)
    model.memories = _memories(*_counted(rows))
    return model


# ---- word counts and scores over all documents ----


def _token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and document of every token: words in lower case, and one end a document."""
    n = len(offsets) - 1
    data = tx.lower(data)
    starts, ends, bounds = tx.word_spans(data, offsets)
    return np.concatenate([tx.byte_prefix(data).spans(starts, ends), np.full(n, END_KEY)]), np.concatenate([tx.per_document(bounds), np.arange(n)])


#: Distinct tokens that a task gathers before it passes their counts on.
_GATHERED = 1 << 19


def word_counts(training: DataFrame) -> DataFrame:
    """key, n: how often each token comes in the texts. Tasks add up their own rows first."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merge():
            k = np.concatenate([keys, *[x for x, _ in new]])
            c = np.concatenate([counts, *[x for _, x in new]])
            seen, back = np.unique(k, return_inverse=True)
            return seen, np.bincount(back, weights=c, minlength=seen.size).astype(np.int64)

        waiting = 0
        for b in batches:
            for _, _, data, offsets in tx.blocks(b.column(0)):
                new.append(np.unique(_token_keys(data, offsets)[0], return_counts=True))
                waiting += new[-1][0].size
                if waiting > _GATHERED:
                    keys, counts = merge()
                    new, waiting = [], 0
                    if keys.size > _GATHERED:
                        yield record_batch(schema, tx.as_long(keys), counts)
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merge()
        if keys.size:
            yield record_batch(schema, tx.as_long(keys), counts)

    return training.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


#: Columns of the tokens that need counts that are not kept.
_OPEN = {"key": pa.int64(), "left": pa.float32(), "pair_key": pa.int64(), "pair_left": pa.float32(), "pair_total": pa.float32()}


def _opened(scored: DataFrame, found: DataFrame, contexts: DataFrame) -> DataFrame:
    """row, open_score: what is missing of the scores of rows with open tokens. The most frequent keys are not among
    these, so no key is many rows."""
    flat = scored.select("row", F.inline(F.arrays_zip("key", "left"))).withColumn("total", F.lit(1.0))
    deep = scored.select("row", F.inline(F.arrays_zip("pair_key", "pair_left", "pair_total"))).withColumn("pair", F.col("pair_key") % (IDS * IDS))
    pairs = found.where("size = 2").select(F.col("key").alias("pair"), "n")
    deep = deep.join(pairs, "pair", "left").withColumn("share", (F.coalesce(F.col("n") - DISCOUNT, F.lit(0.0)) + F.col("pair_left")) / F.col("pair_total"))
    of = contexts.where("size = 3").select("context", "total", "distinct")
    deep = deep.select("row", F.col("pair_key").alias("key"), F.expr(f"pair_key div {IDS}").alias("context"), "share").join(of, "context", "left")
    deep = deep.select("row", "key", F.coalesce(F.col("share") * DISCOUNT * F.col("distinct"), "share").alias("left"), F.coalesce(F.col("total").cast("double"), F.lit(1.0)).alias("total"))
    triples = found.where("size = 3").select("key", "n")
    tokens = flat.select("row", "key", "left", "total").unionByName(deep).join(triples, "key", "left")
    return tokens.groupBy("row").agg(F.sum(F.log10((F.coalesce(F.col("n") - DISCOUNT, F.lit(0.0)) + F.col("left")) / F.col("total"))).alias("open_score"))


def _scored(texts: DataFrame, model: Model, top: pa.Table, totals) -> DataFrame:
    """row, doc_id, n_tokens, what the broadcast words, pairs and triples say of the scores of each text, and what else
    they need."""
    top_keys = top["key"].to_numpy().view(np.uint64)
    by = np.argsort(top_keys)
    log = lambda c: np.log10((c + 0.5) / (totals.n + 0.5 * (totals.v + 1)))
    shared = texts.sparkSession.sparkContext.broadcast((model, model.table(), top_keys[by], log(top["n"].to_numpy()[by])))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_top", pa.int64()), ("top_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), *[(c, pa.list_(t)) for c, t in _OPEN.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, known_keys, logs = shared.value
        for b in batches:
            for lo, hi, data, offsets in tx.blocks(b.column(1)):
                n = hi - lo
                keys, doc = _token_keys(data, offsets)
                distinct, back = np.unique(keys, return_inverse=True)
                at, hit = _found(known_keys, distinct)
                value = np.where(hit, logs[at] if known_keys.size else 0.0, 0.0)
                is_top = hit[back]
                rare = np.unique(np.stack([doc[~is_top], back[~is_top]]), axis=1, return_counts=True) if not is_top.all() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                (rare_doc, rare_key), times = rare
                ends = np.searchsorted(rare_doc, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tx.as_long(distinct[rare_key])))
                numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))
                ids, bounds = _listed(b.column(2).slice(lo, n))
                known, rest = _parts(model, table, ids, bounds, 256, True)
                opened = []
                for c, t in _OPEN.items():
                    ends = np.searchsorted(rest.pair_doc if c.startswith("pair") else rest.doc, np.arange(n + 1)).astype(np.int32)
                    opened.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(getattr(rest, c), t)))
                yield record_batch(schema, b.column(0).slice(lo, n), np.bincount(doc, minlength=n), np.bincount(doc[is_top], minlength=n), np.bincount(doc, weights=value[back], minlength=n), known, lists, numbers, *opened)

    types = "key array<long>, left array<float>, pair_key array<long>, pair_left array<float>, pair_total array<float>"
    scored = texts.select("doc_id", "text", "ids").mapInArrow(tidy(run), f"doc_id long, n_tokens long, n_top long, top_score double, score double, rare array<long>, times array<int>, {types}")
    return scored.withColumn("row", F.monotonically_increasing_id())


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    training = docs.where(~in_fold("doc_id", folds, fold))
    with shuffles_freed(spark):
        counts = written(word_counts(training), "word-counts")
        totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        top = most_frequent(counts, "n", "key", TOP_WORDS).select("key", "n").toArrow()
        with written_meanwhile(encoded(docs, ~in_fold("doc_id", folds, fold), vocabulary), "encoded", "zstd") as texts:
            model = _fitted(texts.where("training"))
            found, contexts = _counted(texts.where("training"))
            model.memories = _memories(found, contexts)
            scored = written(_scored(texts, model, top, totals), "scored", "zstd")  # written once, so the numbers stay
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.join(counts, "key", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(float(totals.n + 0.5 * (totals.v + 1))))).alias("rare_score"))
    out = scored.select("row", "doc_id", "n_tokens", "n_top", "top_score", "score").join(rare, "row", "left").join(_opened(scored, found, contexts), "row", "left")
    return out.select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "n_tokens", (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(int(totals.n)).cast("long").alias("train_tokens"), (F.col("top_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("open_score", F.lit(0.0))).alias("score"))
