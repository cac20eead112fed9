"""Chunks in batches and streams, against the whole sequences."""

import random
import time

from pyspark.sql import functions as F
from tetragrid.operators import fcgr
from tetragrid.operators.fcgr import fcgr_counts
from tetragrid.operators.point import final_point
from tetragrid.operators.ranges import ranged
from tetragrid.plans import registry
from tetragrid.streaming.chunks import InOrder, chunk_counts, chunked_final_point, joined_chunks, points, state_store, stream_cells, stream_final_point

SCHEMA = "conv_id long, turn long, text string"


def chunked():
    rng = random.Random(5)
    rows = [(1, t, "".join(rng.choice("ACGTacgtN ") for _ in range(rng.randrange(4)))) for t in range(300)]
    rows += [(i, t, rng.choice(("A", "", None, "GATTACA"))) for i in range(2, 9) for t in range(rng.randrange(6))]
    rows += [(40, t, "".join(rng.choice("ACGT") for _ in range(30)) if t % 4 else "CG" * 20) for t in range(40)] + [(41, 0, "TTT"), (41, 1, "C" * 70), (41, 2, "A")]
    return rows + [(20, t, "CG" * (t % 3)) for t in range(60)] + [(20, 99, "TTA"), (None, 0, "AC"), (None, 1, "GT"), (30, 7, "xx")]


def plain(bases, k, x=0.5, y=0.5):
    found = fcgr.Counter()
    end = fcgr.walk(bases, 2**k, found, x, y)
    return dict(fcgr.named_cells(found, k)), end


def carrying(rng):
    """Sequences of stretches whose float64 walks carry, meet and never meet."""
    parts = []
    for _ in range(rng.randrange(1, 9)):
        kind, n = rng.randrange(6), rng.randrange(30, 70)
        parts.append(rng.choice(("C", "G", "A", "T")) * n if kind < 2 else "".join(rng.choice(rng.choice(("CG", "GT"))) for _ in range(n)) if kind == 2 else "".join(rng.choice("CG") for _ in range(n)) if kind == 3 else rng.choice(("CG", "GT", "CA", "AC", "TG")) * n if kind == 4 else "".join(rng.choice("ACGT") for _ in range(3 * n)))
    return "".join(parts)


def named(found, k):
    return dict(zip(fcgr.cell_names(found[0], k).to_pylist(), found[1].tolist(), strict=True))


def test_restarted_walks_are_those_of_all_bases():
    rng, open_ = random.Random(1), 0
    for _ in range(1500):
        bases, k = carrying(rng), rng.choice((1, 2, 3, 4, 6, 7, 8, 10))
        want, end = plain(bases, k)
        assert named(fcgr.window_cells(bases, k), k) == want and fcgr.end_point(bases) == end
        cut = rng.randrange(len(bases) + 1)
        first, at = plain(bases[:cut], k)
        known = fcgr.window_cells(bases[cut:], k, bases[:cut][-128:], None)
        open_ += known is None
        assert known is None or named(known, k) == plain(bases[cut:], k, *at)[0]
    assert 0 < open_ < 300


def test_a_long_sequence_is_walked_near_its_runs_only(monkeypatch):
    bases = list("".join(random.Random(2).choices("ACGT", k=10_000_000)))
    for at in (100, 3_000_000, 9_999_900):
        bases[at : at + 60] = "C" * 60
    bases, steps = "".join(bases), 0
    plain_path = fcgr._path

    def counted(part, x, y):
        nonlocal steps
        for p in plain_path(part, x, y):
            steps += 1
            yield p

    monkeypatch.setattr(fcgr, "_path", counted)
    found, end = named(fcgr.window_cells(bases, 6), 6), fcgr.end_point(bases)
    assert steps < 5000
    assert (found, end) == plain(bases, 6)


def test_counts_of_chunks_are_those_of_whole_sequences(spark):
    rows = spark.createDataFrame(chunked(), SCHEMA).repartition(5)
    for k in (1, 3, 6):
        got = sorted(map(tuple, chunk_counts(rows, k).collect()), key=str)
        want = fcgr_counts(joined_chunks(rows), k, id_col="id", seq_col="seq").select("id", "z", "cnt")
        assert got == sorted(map(tuple, want.collect()), key=str)


def test_end_points_of_chunks_are_those_of_whole_sequences(spark):
    rows = spark.createDataFrame(chunked(), SCHEMA).repartition(5)
    for precision in (4, 64, 512):
        want = final_point(joined_chunks(rows), precision, id_col="id", seq_col="seq")
        assert sorted(map(tuple, chunked_final_point(rows, precision).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert chunked_final_point(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chunks_of_a_conversation_are_not_gathered(spark, tmp_path):
    spark.createDataFrame(chunked(), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = registry.chunked_fcgr_k3(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [conv_id" not in plan and "collect_list(struct" not in plan and "Generate" not in plan


def test_ranges_hold_rows_in_order(spark):
    rng = random.Random(3)
    values = [(None if rng.random() < 0.1 else rng.randrange(500), "x" * rng.randrange(3)) for _ in range(3000)] + [(7, "hot")] * 2000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = ranged(spark.createDataFrame(values, "a long, b string"), "a", "b").distinct().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (r.a is not None, r.a or 0, r.b))
    parts = [r["_part"] for r in order]
    assert parts == sorted(parts) and len(set(parts)) > 30 and len(order) == len(set(values))
    assert ranged(spark.createDataFrame([], "a long"), "a").collect() == []


def in_triggers(spark, folder, triggers, operator, mode):
    """What the operator puts out for tables that come one by one."""
    for rows in triggers:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = operator(stream)
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/trigger={n}")
    with state_store(spark):
        out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def shuffled():
    rng = random.Random(8)
    rows = [(i, t, "CG" * 40 if i == 0 else "".join(rng.choice("ACGTn") for _ in range(rng.randrange(30)))) for i in range(4) for t in range(12)] + [(None, 1, "GT"), (None, 0, "AC"), (7, 0, None)]
    rng.shuffle(rows)
    return rows, [rows[i::5] for i in range(5)]


def test_shuffled_triggers_give_the_batch_answer(spark, tmp_path):
    rows, triggers = shuffled()
    whole = joined_chunks(spark.createDataFrame(rows, SCHEMA))
    added = in_triggers(spark, tmp_path / "cells", triggers, lambda c: stream_cells(c, 3), "append").groupBy("id", "z").agg(F.sum("cnt").alias("cnt"))
    want = fcgr_counts(whole, 3, id_col="id", seq_col="seq").select("id", "z", "cnt")
    assert sorted(map(tuple, added.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    seen = in_triggers(spark, tmp_path / "points", triggers, lambda c: stream_final_point(c, 64), "update")
    last = seen.groupBy("id").agg(F.max_by("tail", "iterations").alias("tail"), F.max("iterations").alias("iterations"), F.max("gaps").alias("gaps"), F.max("late").alias("late"))
    want = final_point(whole, 64, id_col="id", seq_col="seq")
    assert sorted(map(tuple, points(last, 64).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(r.gaps, r.late) for r in last.collect()} == {(0, 0)}


def last_of(rows):
    return {r.id: (r.tail, r.gaps, r.late) for r in sorted(rows, key=lambda r: (r.iterations, r.gaps, r.late))}


def test_missing_chunks_are_given_up_and_late_ones_left_out(spark, tmp_path):
    triggers = [[(1, 0, "AA"), (1, 3, "CC"), (2, 1, "T"), (3, 0, "G"), (3, None, "TT")], [(1, 4, "GG"), (1, 6, "TT"), (3, 0, "C"), (3, 1, "A")], [(1, 1, "T"), (3, 1, "A")]]
    few = in_triggers(spark, tmp_path / "few", triggers, lambda c: stream_final_point(c, 8, patience=None, most=2), "update").collect()
    assert last_of(few) == {1: ("AACCGG", 2, 1), 3: ("GA", 0, 3), 2: ("", 0, 0)}


def test_what_is_missing_is_given_up_in_time(spark, tmp_path):
    spark.createDataFrame([(2, 1, "T"), (1, 0, "A")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    with state_store(spark):
        out = stream_final_point(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 8, patience=1)
        query = out.writeStream.foreachBatch(lambda batch, n: seen.extend(batch.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
        end = time.time() + 60
        while time.time() < end and not any(r.gaps for r in seen):
            time.sleep(0.5)
        query.stop()
    assert last_of(seen) == {1: ("A", 0, 0), 2: ("T", 1, 0)}


def test_chunks_of_a_stream_are_rows_and_no_tables():
    class Value:
        own = None

        def get(self):
            return self.own

        def update(self, value):
            self.own = value

    class Waiting(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop  # noqa: N815

    class Handle:
        getValueState, getMapState = (lambda *_: Value()), (lambda *_: Waiting())  # noqa: N815

    fold = lambda name, own, bases, gaps, late: ((own[0] + bases,), [(name, own[0] + bases, late)])
    chunks = InOrder(fold, "tail string", ("",), 0, None, 9)
    chunks.init(Handle())
    put_out = [r for rows in ([(7, 1, "C")], [(7, 0, "A"), (7, 0, "G")], [(7, 2, "T")]) for r in chunks.handleInputRows((7,), iter(rows), None)]
    assert put_out == [(7, "", 0), (7, "AC", 1), (7, "ACT", 1)]
