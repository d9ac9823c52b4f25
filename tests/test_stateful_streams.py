"""Stateful streams against one batch: shuffled, repeated and late micro-batches, restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cardloom.operators import lifecycle
from cardloom.streaming import state, tail

LOG = "id string, seq long, at timestamp, fact string, superseded_by string"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def log_rows(n=240, seed=3):
    rng, rows, now = random.Random(seed), [], {}
    for i in range(n):
        card = f"c{rng.randrange(25)}"
        if card not in now or rng.random() < 0.3:
            now[card] = rng.choice([None, None, "x", "y"])
        rows.append((card, i, at(i), f"fact {i} " + "long " * 20, now[card]))
    return rows


def feed(spark, folder, rows, schema, files, seed=0):
    """The rows as files that a stream takes one by one; each moves rows by up to some minutes, and has some twice."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(-20, 20))
    size = -(-len(order) // files)
    for k in range(files):
        part = order[k * size : (k + 1) * size]
        part = part + rng.sample(part, len(part) // 4) + (rng.sample(order[max(0, k * size - 5) : k * size], 3) if k else [])
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def read_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_watch_equals_a_diff_of_the_whole_log(spark, tmp_path):
    rows = log_rows()
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("log", "out", "cp"))
    feed(spark, src, rows[:120], LOG, 3, seed=1)
    tail.run_once(state.watch(read_stream(spark, src, LOG), late="1 hour"), out, cp)
    # a restart from the checkpoint, then a row that moves the watermark past all others, and one that comes too late
    feed(spark, src, rows[120:], LOG, 3, seed=2)
    spark.createDataFrame([("end", 10_000, at(10_000), "end", None)], LOG).coalesce(1).write.mode("append").parquet(src)
    tail.run_once(state.watch(read_stream(spark, src, LOG), late="1 hour"), out, cp)
    spark.createDataFrame([("c1", 10_001, at(1), "late", "z")], LOG).coalesce(1).write.mode("append").parquet(src)
    tail.run_once(state.watch(read_stream(spark, src, LOG), late="1 hour"), out, cp)
    got = {tuple(r) for r in spark.read.parquet(out).where("id <> 'end'").collect()}
    want = state.changes(spark.createDataFrame(rows, LOG))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 40
    assert {r.kind for r in want.select("kind").distinct().collect()} == {"new", "audit", "superseded"}
    assert spark.read.parquet(out).where("id <> 'end'").count() == len(got)  # nothing twice


def test_changes_of_odd_logs(spark):
    rows = [("a", 1, at(1), None, "x"), ("a", 1, at(1), None, "x"), ("a", 2, at(2), "f", "x"), ("a", 3, at(3), "f", None), ("b", 9, at(9), "é" * 80, None), ("b", 8, at(8), "g", None), (None, 1, at(1), "f", None)]
    got = {(r.id, r.seq, r.kind, r.fact, r.superseded_by) for r in state.changes(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {("a", 1, "audit", None, "x"), ("a", 3, "superseded", "f", None), ("b", 8, "new", "g", None), (None, 1, "new", "f", None)}
    assert state.changes(spark.createDataFrame([], LOG)).count() == 0


def test_touches_as_a_stream_equal_the_fold(spark, tmp_path):
    touch = "id string, seq long, at timestamp"
    rng = random.Random(9)
    rows = [(f"c{rng.randrange(12)}", i, at(i)) for i in range(200)]
    cards = spark.createDataFrame([(f"c{i}", i % 4, 1_700_000_000.0, 1.0 + i % 3 / 2, i % 3 / 2) for i in range(11)], "id string, access_count long, last_access double, stability double, importance double")
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("log", "out", "cp"))
    feed(spark, src, rows[:90], touch, 2, seed=5)
    start = lambda: state.fold(read_stream(spark, src, touch), cards, late="1 hour")
    tail.run_once(start(), out, cp)
    feed(spark, src, rows[90:], touch, 2, seed=6)
    spark.createDataFrame([("end", 10_000, at(10_000))], touch).coalesce(1).write.mode("append").parquet(src)
    tail.run_once(start(), out, cp)
    log = spark.createDataFrame(rows, touch).selectExpr("id", "unix_millis(at) / 1000D as at")
    want = {r.id: r for r in lifecycle.fold_touches(cards, log).collect()}
    newest = spark.read.parquet(out).groupBy("id").agg(F.max_by(F.struct("access_count", "last_access", "stability"), "access_count").alias("x")).select("id", "x.*").collect()
    assert {r.id for r in newest} == {f"c{i}" for i in range(11)}  # all were touched; c11 isn't a card
    for r in newest:
        assert (r.access_count, r.last_access, round(r.stability, 9)) == (want[r.id].access_count, want[r.id].last_access, round(want[r.id].stability, 9))
