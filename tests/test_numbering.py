"""Numbers, chunks and islands against plain versions, and no window without a partition in their plans."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import health
from quillspark.operators.numbering import numbered
from quillspark.plans import catalog


def test_numbers(spark):
    rng = random.Random(2)
    for n in (0, 1, 5, 3000):
        rows = [(rng.choice(["a", "b", None, "é"]), rng.randint(0, 10**6), i) for i in range(n)]
        frame = spark.createDataFrame(rows, "k string, v long, number_ long").repartition(7)
        got = [tuple(r) for r in numbered(frame, [F.col("k").desc_nulls_first(), F.col("v"), F.col("number_")]).orderBy("number").collect()]
        want = sorted(rows, key=lambda r: (r[0] is not None, [-ord(c) for c in r[0] or ""], r[1], r[2]))
        assert [r[:3] for r in got] == want and [r[3] for r in got] == list(range(1, n + 1))


def test_one_key_for_all(spark):
    """Rows that tie are still numbered without gaps."""
    got = numbered(spark.range(500).select(F.lit(1).alias("k")), ["k"]).select("number").collect()
    assert sorted(r[0] for r in got) == list(range(1, 501))


def test_islands_by_sets(spark):
    rng = random.Random(8)
    days = [f"2024-01-{i:02d}" for i in range(1, 29)]
    sets = {d: rng.choice([set(), {"A"}, {"A", "B"}, {"B"}, {"C", "A"}]) for d in days}
    missing = spark.createDataFrame([(t, d) for d, s in sets.items() for t in s] * 2, "ticker string, date string").withColumn("date", F.to_date("date"))
    valid = spark.createDataFrame([(d,) for d in days], "date string").withColumn("date", F.to_date("date"))
    want, at = [], None
    for d in days:
        if at is not None and sets[d] == at[2]:
            at[1] = d
        else:
            at = [d, d, sets[d]]
            want.append(at)
    got = sorted((str(r.start), str(r.end), r.tickers) for r in health.islands(missing, valid).collect())
    assert got == [(a, b, ",".join(sorted(s))) for a, b, s in want if s]


@pytest.mark.parametrize("name", ["backfill_batches", "momentum_targets", "rebalance_decisions", "order_sizing", "sma_decisions"])
def test_plans(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(" in line and not _partitioned(line)], plan


def _partitioned(line: str) -> bool:
    """Window [functions], [partition keys], [order]: the keys are not empty."""
    return line.split("windowspecdefinition(")[1].split(" ASC")[0].split(" DESC")[0].count(",") >= 1
