import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tetragrid.functions import sql
from tetragrid.functions.bases import critical_value
from tetragrid.operators import fcgr, metrics, point, quadtree
from tetragrid.plans import registry
from tetragrid.streaming.chunks import points, stream_final_point

SF = "/root/testdata/sf0.001"
TABLES = "orders part documents labels conversations".split()


def walk(seq, k):
    """The float walk, step by step, as digits."""
    x = y = 0.5
    out = {}
    for b in (c for c in seq.upper() if c in "ACGT"):
        x, y = (x + (b in "CG")) / 2, (y + (b in "GT")) / 2
        i, j = min(int(x * 2**k), 2**k - 1), min(int(y * 2**k), 2**k - 1)
        z = "".join(str(2 * (i >> s & 1) + (j >> s & 1)) for s in reversed(range(k)))
        out[z] = out.get(z, 0) + 1
    return out


def test_counts_are_those_of_the_float_walk(spark):
    rng = random.Random(5)
    seqs = ["", "ACGT", "acgtNNacgt", "GATTACA", "C" * 54 + "A", "C" * 47 + "A" * 6 + "C", "GT" * 27 + "ACAAAACA", "G" * 200]
    seqs += ["".join(rng.choice("ACGTNacgt") for _ in range(rng.randrange(120))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(seqs)) + [(99, None)], "doc_id long, text string")
    for k in (1, 2, 7):
        got = {}
        for r in fcgr.fcgr_counts(rows, k).collect():
            got.setdefault(r.id, {})[r.z] = r.cnt
        assert got == {i: w for i, s in enumerate(seqs) if (w := walk(s, k))}


def recursive_leaves(cells, depth, crit, least, node=""):
    own = {z: c for z, c in cells.items() if z.startswith(node)}
    total = sum(own.values())
    kids = [sum(c for z, c in own.items() if z.startswith(node + q)) for q in "0123"]
    if len(node) < depth and total >= least and total and 4 * sum(c * c for c in kids) / total - total > crit:
        return [x for q in "0123" for x in recursive_leaves(cells, depth, crit, least, node + q)]
    return [(node, total / 4 ** (depth - len(node)) / sum(cells.values()))] if total else []


def test_leaves_are_those_of_the_recursive_tree(spark):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("AACGT") for _ in range(n)) for n in (1, 9, 60, 300)] + ["CCGACGATTTGA"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "doc_id long, text string")
    counts = fcgr.fcgr_counts(rows, 3)
    for threshold, least in ((0.05, 8), (1.0, 0), (0.0, 8), (1.5, 0)):
        got = sorted((r.id, r.node, r.value) for r in quadtree.qt_leaves(counts, 3, threshold, least).collect())
        assert got == sorted((i, *leaf) for i, s in enumerate(seqs) for leaf in recursive_leaves(walk(s, 3), 3, critical_value(threshold), least))


@pytest.mark.parametrize(("p", "x"), [(0.5, 2.365973884375338), (0.1, 6.251388631170324), (0.05, 7.81472790325118), (0.01, 11.344866730144373), (0.001, 16.266236196238133)])
def test_critical_values(p, x):
    assert critical_value(p) == pytest.approx(x, rel=1e-13)


def test_final_point_is_the_integer_recurrence(spark):
    seqs = ["", "C" + "ACGT" * 16, "T" + "ACGT" * 16, "GATTACA", "ACANNA"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "doc_id long, text string")
    for r in point.final_point(rows, 64).collect():
        x = y = 2**63
        for b in (c for c in seqs[r.id] if c in "ACGT"):
            x, y = (x + (b in "CG") * 2**64) >> 1, (y + (b in "GT") * 2**64) >> 1
        assert (int(r.x_bits, 2), int(r.y_bits, 2)) == (x, y)
    one = spark.createDataFrame([("1" * 60,)], "b string").select(point.bits_to_float("b").alias("f"), point.bits_to_fraction("b").alias("q")).first()
    assert one.f == 1.0 and one.q.denominator == str(2**60)


def test_guards():
    with pytest.raises(ValueError):
        fcgr.extract_kmer_features(None, 8, 128)
    with pytest.raises(ValueError):
        quadtree.extract_adaptive_features(None, 96, 5)


def test_auroc_without_one_class_is_nan(spark):
    rows = spark.createDataFrame([(True, 1.0), (True, 0.5)], "positive boolean, score double")
    assert str(metrics.auroc(rows).first().auroc) == "nan"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _repeated(spark):
    rng, rows = random.Random(5), []
    for i in range(40):
        rows += [(i % 7 if i % 5 else None, "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 30, 200]))))]
    return spark.createDataFrame([*rows, *rows[:9], (3, None), (3, "C" * 120)], "doc_id long, text string").repartition(3)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counts_hold_bases_and_no_cells(spark, monkeypatch):
    rows = _repeated(spark)
    assert "Aggregate" not in _plan(fcgr.fcgr_counts(rows, 6)) and "Aggregate" not in _plan(fcgr.fcgr_counts(rows, 6, at=4))
    want = Counter()
    for doc_id, text in rows.collect():
        b = "".join(c for c in text or "" if c in "ACGT")
        for cell, n in zip(*fcgr.window_cells(b, 3), strict=True):
            want[doc_id, len(b), fcgr.cell_names(np.array([cell]), 3)[0].as_py()] += n
    got = {(r.id, r.n, r.z): r.cnt for r in fcgr.fcgr_counts(rows, 3).collect()}
    assert got == want
    with pytest.raises(ValueError):
        fcgr.fcgr_counts(rows, 3, at=4)
    assert _sorted(fcgr.fcgr_counts(rows, 6, at=4)) == _sorted(fcgr.pooled(fcgr.fcgr_counts(rows, 6), 4))
    one = [pa.RecordBatch.from_pylist([{"id": i // 2, "b": "ACGT" * 9} for i in range(6)])]
    monkeypatch.setattr(fcgr, "HELD_CELLS", 1)
    put_out = list(fcgr._sequences(2, lambda cells: [cells.rows(np.arange(len(cells.cell)), ("cnt", pa.array(cells.count)))])(iter(one)))
    assert [set(b.column(0).to_pylist()) for b in put_out] == [{0}, {1}, {2}] and {sum(b.column(1).to_pylist()) for b in put_out} == {72}


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_leaves_and_features_of_sequences_are_those_of_counts(spark, depth):
    rows = _repeated(spark)
    counts = fcgr.fcgr_counts(rows, max(depth, 1))
    leaves, features = quadtree.sequence_leaves(rows, depth), quadtree.sequence_features(rows, 2, depth)
    assert not any(word in _plan(df) for df in (leaves, features) for word in ("Aggregate", "Union"))
    assert _sorted(leaves) == _sorted(quadtree.qt_leaves(counts, depth))
    if depth:
        assert _sorted(features) == _sorted(quadtree.combined_features(fcgr.fcgr_counts(rows, max(2, depth)), 2, depth))


def test_small_grids_are_counted_in_a_table_and_bases_are_picked_by_bytes(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("acgtACGTnx \u00e9\ufb05\u1e97\u4e2d") for _ in range(n)) for n in (1, 40, 700)] + ["\ufb05", "\u00e9", ""]
    sorted_ = []
    plain = np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **o: sorted_.append(1) or plain(*a, **o))
    for text in texts:
        bases = "".join(c for c in text.upper() if c in "ACGT")
        for k in (1, 3):
            want = Counter(walk(bases, k))
            assert Counter(dict(sql.KmerWindows().eval(text, k))) == want
    assert not sorted_
