"""Streams of several batches: expiry, corrections, upserts that survive a crash and a replay; gaps and coverage in spans."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import derive, gaps, sinks
from marketlens.sources import market, payloads
from marketlens.streaming import epochs, stateful

T = dt.datetime(2024, 3, 1, 12, 0)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def _streamed(spark, frames, schema, tmp_path, make):
    """Rows that a stream over the frames, one batch each, has given in the end."""
    root = str(tmp_path)
    rows = [(k, *r) for k, f in enumerate(frames) for r in f]
    df = spark.createDataFrame(rows, f"_batch int, {schema}")

    def start(live):
        return make(live.drop("_batch")).writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()

    market.in_batches(df, F.col("_batch"), len(frames), root, start)
    return spark.read.parquet(f"{root}/rows")


def test_values_expire_by_timer_and_by_the_next_event(spark, tmp_path):
    frames = [
        [("a", at(0), 1.0), ("a", at(1), 2.0), ("b", at(0), 5.0), (None, at(0), 9.0)],
        [("b", at(3), 6.0), ("b", at(2), 5.5)],
        [("b", at(60), 7.0)],  # the watermark passes all others
        [("a", at(61), 3.0), ("c", at(61), 8.0)],
    ]
    with stateful.state_on_disk(spark):
        out = _streamed(spark, frames, "key string, snapshot_time timestamp, price double", tmp_path, lambda live: stateful.timed_values(live, 600, late="1 minute"))
    got = sorted(((r["key"] or "", r["at"], r["action"], r["payload"]) for r in out.collect()))
    p = lambda x: f'{{"price":{x}}}'
    want = [("", at(0), "set", p(9.0)), ("", at(10), "expire", p(9.0)), ("a", at(0), "set", p(1.0)), ("a", at(1), "set", p(2.0)), ("a", at(11), "expire", p(2.0)), ("a", at(61), "set", p(3.0)), ("b", at(0), "set", p(5.0))]
    want += [("b", at(2), "set", p(5.5)), ("b", at(3), "set", p(6.0)), ("b", at(13), "expire", p(6.0)), ("b", at(60), "set", p(7.0)), ("c", at(61), "set", p(8.0))]
    assert got == sorted(want)


_FLOW = "symbol_id long, exchange string, period string, snapshot_time timestamp, buy_sell_delta_quote double, buy_sell_delta double"


def test_late_flows_correct_the_totals(spark, tmp_path):
    rng = random.Random(1)
    flows = [(1 + k % 2, "x", "1h", at(k), None, float(rng.randint(-9, 9))) for k in range(60)] + [(1, "x", "1h", at(5), None, None)]
    late = [f for k, f in enumerate(flows) if k % 5 == 2]
    frames = [[f for f in flows[:40] if f not in late], late[:3] + [f for f in flows[40:50] if f not in late], late[3:] + [f for f in flows[50:] if f not in late]]
    out = _streamed(spark, frames, _FLOW, tmp_path, lambda live: stateful.corrected_delta(live, late="2 hours"))
    assert out.agg(F.max("revision")).first()[0] == 3
    total, want = {}, []
    for s, x, p, t, _, d in sorted(flows[:60], key=lambda f: f[3]):
        total[s] = total.get(s, 0.0) + d
        want.append((s, x, p, t, total[s], d))
    assert sorted(map(tuple, stateful.newest_revisions(out).collect())) == sorted(want)


def test_totals_before_the_watermark_leave_the_state(spark, tmp_path):
    flows = [(1, "x", "1h", at(10 * k), 1.0, None) for k in range(12)]
    out = _streamed(spark, [flows[:6], flows[6:9], [(1, "x", "1h", at(75), 100.0, None)], flows[9:]], _FLOW, tmp_path, lambda live: stateful.corrected_delta(live, late="10 minutes"))
    got = {r["snapshot_time"]: r["cvd_value"] for r in stateful.newest_revisions(out).collect()}
    assert [got[at(10 * k)] for k in range(8)] == [float(k + 1) for k in range(8)] and got[at(75)] == 108.0
    assert got[at(80)] == 109.0 and got[at(110)] == 112.0
    assert out.where(F.col("snapshot_time") == F.lit(at(0))).count() == 1  # done, and never given again


def _newest(old, new):
    return sinks.upsert(old, new, ["k", "day"])


_ROWS = "k long, v string, day date"


def _table(spark, root, epoch=None):
    return sorted((r["k"], r["v"], str(r["day"])) for r in epochs.read_table(spark, root, _ROWS, epoch).collect())


def test_epochs_replay_and_crash_change_nothing(spark, tmp_path):
    root, d = str(tmp_path / "t"), lambda n: dt.date(2024, 1, n)
    batch = lambda *rows: spark.createDataFrame(rows, _ROWS)
    assert _table(spark, root) == [] and epochs.last_epoch(spark, root) == -1
    first = batch((1, "a", d(1)), (2, "b", d(2)))
    assert epochs.write_epoch(spark, first, root, "day", _newest, 0)
    before = _table(spark, root)
    second = batch((1, "A", d(1)), (3, "c", d(3)))
    with pytest.raises(RuntimeError):
        epochs.write_epoch(spark, second, root, "day", _newest, 1, fail=True)
    assert _table(spark, root) == before and epochs.last_epoch(spark, root) == 0  # files are there, but nothing changed
    assert epochs.write_epoch(spark, second, root, "day", _newest, 1)
    after = [(1, "A", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", "2024-01-03")]
    assert _table(spark, root) == after and _table(spark, root, 0) == before
    assert not epochs.write_epoch(spark, batch((1, "replayed", d(1))), root, "day", _newest, 1)
    assert not epochs.write_epoch(spark, first, root, "day", _newest, 0)
    assert _table(spark, root) == after
    assert epochs.write_epoch(spark, batch(), root, "day", _newest, 2) and _table(spark, root) == after  # an empty batch
    assert epochs.write_epoch(spark, batch((9, None, None)), root, "day", _newest, 3) and (9, None, "None") in _table(spark, root)


def test_rows_before_in_spans(spark):
    rng = random.Random(2)
    rows = [(s, rng.randint(0, 400)) for s in (1, 2, None) for _ in range(60)]
    df = spark.createDataFrame(rows, "s long, at long").distinct()
    want = df.withColumn("b", F.lag("at").over(Window.partitionBy("s").orderBy("at")))
    for span in (1, 7, 1000):
        assert sorted(map(repr, gaps._before(df, ["s"], "at", span, "b").select("s", "at", "b").collect())) == sorted(map(repr, want.collect()))


def test_missing_runs_are_the_missing_slots(spark):
    rng = random.Random(3)
    policies = spark.createDataFrame([("x", "ticker", "1h", 3600, True), ("x", "oi", "1h", 3600, True), ("x", "oi", "5m", 300, True), ("y", "ticker", "1h", 3600, False)], "exchange string, data_type string, period string, interval_seconds long, enabled boolean")
    markets = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "symbol_id long, exchange string")
    facts = spark.createDataFrame([(rng.randint(1, 3), "x", at(rng.randint(-200, 2000))) for _ in range(80)], "symbol_id long, exchange string, snapshot_time timestamp")
    for start, end in (("2024-03-01 12:00:00", "2024-03-02 12:00:00"), ("2024-03-01 12:10:00", "2024-03-01 12:50:00"), ("2024-03-02", "2024-03-02")):
        slots = gaps.missing_slots(gaps.coverage_slots(policies, markets, start, end), facts, "snapshot_time")
        runs = gaps.run_slots(gaps.missing_runs(policies, markets, facts, start, end))
        names = sorted(slots.columns)
        assert sorted(map(tuple, runs.select(*names).collect())) == sorted(map(tuple, slots.select(*names).collect()))


def test_audit_keeps_torn_lines_once(spark, tmp_path):
    good = '{"exchange":"Binance","data_type":"ticker","source_symbol":"S","payload_time":"2024-01-01T00:00:00Z","payload":"{}"}'
    lines = [good, good, good.replace('"S"', "null"), good.replace('"{}"', '"no json"'), good[:30], good[:30], good.replace('"{}"', '"{\\"code\\": -1}"'), good.replace('"{}"', "null")]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "lines"))
    got = payloads.audited(payloads.read_lines(spark, str(tmp_path / "lines"))).collect()
    assert sorted((r["capture_reason"], r["source_symbol"] or "", r["payload"] or "", r["captures"]) for r in got) == [
        ("audit", "", "{}", 1), ("audit", "S", "{}", 2), ("failed_job", "", good[:30], 2), ("quality_issue", "S", "", 1), ("quality_issue", "S", "no json", 1), ("quality_issue", "S", '{"code": -1}', 1)]
    assert len({r["payload_hash"] for r in got}) == 5


def test_late_flows_of_the_tables(spark, sf, tmp_path):
    f = derive.fill_taker_flow(market.taker_flows(spark, sf)).where("symbol_id = 1")
    half = F.when(F.unix_micros("snapshot_time") % 2 == 0, 1).otherwise(0)
    root = str(tmp_path)
    market.in_batches(f, half, 2, root, lambda live: stateful.corrected_delta(live, late="60 days").writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    got = stateful.newest_revisions(spark.read.parquet(f"{root}/rows"))
    want = derive.cumulative_delta(f)
    on = ["symbol_id", "exchange", "period", "snapshot_time"]
    both = got.select(*on, F.col("cvd_value").alias("a")).join(want.select(*on, F.col("cvd_value").alias("b")), on)
    assert both.count() == want.count() and both.where("abs(a - b) > 1e-6").count() == 0
