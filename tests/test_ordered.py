import random

import pytest
from pyspark.sql import functions as F

from bicspark.operators.ordered import before, positions
from bicspark.plans.stages import Stages


@pytest.fixture
def many_parts(spark):
    keys = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_running_aggregates_of_a_group_over_many_partitions(spark, many_parts):
    """One group holds nine tenths of the rows; null is a group; ties take any order."""
    rng = random.Random(2)
    rows = [(rng.choice([None, 5] + [7] * 18), k, rng.choice([None, *range(9)])) for k in range(2000)]
    frame = spark.createDataFrame(rows, "g int, k int, v int")
    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "x": ("xor", F.col("v").cast("bigint"))}
    stages = Stages(spark)
    got = {r.k: (r.s, r.m, r.x) for r in before(frame, ["g"], ["k"], values, stages).collect()}
    state = {}
    for g, k, v in rows:
        s, m, x = state.setdefault(g, (0, None, 0))
        assert got[k] == (s, m, x)
        if v is not None:
            state[g] = (s + v, v if m is None else max(m, v), x ^ v)
    assert len(got) == 2000 and before(frame.where("false"), ["g"], ["k"], values, stages).count() == 0


def test_positions_have_no_gaps(spark, many_parts):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), k) for k in range(1000)]
    frame = spark.createDataFrame(rows, "a int, b int")
    got = [(r.a, r.b) for r in positions(frame, [F.desc("a"), F.asc("b")], Stages(spark)).orderBy("position").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [r.position for r in positions(frame, [F.asc("b")], Stages(spark)).orderBy("b").collect()] == list(range(1, 1001))
