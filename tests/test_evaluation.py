"""Queries that judge detectors, on tables made for their limits."""

import functools
import itertools
import operator

import duckdb

from bayline.plans import evaluation


def test_ladder_does_not_hang_on_the_order_of_the_sum(spark, tmp_path):
    """Slots whose mean is the limit itself, in orders whose sums fall on either side of it."""
    mean = lambda p: functools.reduce(operator.add, p, 0.0) / len(p)  # noqa: E731  (sum() would make up for lost bits)
    orders = [p for p in itertools.permutations((0.0, 0.01, 0.02, 0.03, 0.08, 0.1, 0.06, 0.1)) if mean(p) < 0.05][:3]
    assert orders
    rows = [(f, n, n, n, 1.0, v, 0.0, "A", "F") for f, p in enumerate([*orders, (0.04,) * 8, (0.05,) * 8]) for n, v in enumerate(p)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    expected = {f: "uncertain" if f == len(orders) else "detected" for f in range(len(orders) + 2)}
    assert {r.frame: r.status for r in evaluation.slot_count_ladder(spark, str(tmp_path)).collect()} == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    assert {f: status for f, _, status in con.execute(evaluation.ORACLES["slot_count_ladder"]).fetchall()} == expected
