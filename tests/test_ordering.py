import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkaudit.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a third of the rows on one value, some null groups."""
    rng = random.Random(1)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"g{rng.randint(0, 40)}")
        value = 5.0 if i % 3 == 1 else rng.random() * 100
        rows.append((i, group, value))
    return spark.createDataFrame(rows, "id int, g string, v double").repartition(5).cache()


def test_cells_are_bounded(spark, skewed, many_segments):
    cells = O.with_segment(skewed, ["v", "id"]).groupBy("g", O.SEGMENT).count()
    assert cells.agg(F.max("count")).first()[0] <= 4 * many_segments


@pytest.mark.parametrize("by", [[], ["g"]])
def test_rank_total_previous(spark, skewed, many_segments, by):
    w = W.partitionBy(*by).orderBy("v", "id")
    got = O.ranked(skewed, ["v", "id"], by, "r", "n", F.col("v") > 5)
    want = skewed.withColumn("r", F.row_number().over(w)).withColumn(
        "n", F.count_if(F.col("v") > 5).over(W.partitionBy(*by)))
    assert sorted(map(str, got.select("id", "r", "n").collect())) == sorted(map(str, want.select("id", "r", "n").collect()))
    got = O.running_total(skewed, "id", ["v", "id"], by, "b")
    want = skewed.withColumn("b", F.coalesce(F.sum("id").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    assert sorted(map(str, got.select("id", "b").collect())) == sorted(map(str, want.select("id", "b").collect()))
    got = O.previous_value(skewed, "id", ["v", "id"], by, "p")
    want = skewed.withColumn("p", F.lag("id").over(w))
    assert sorted(map(str, got.select("id", "p").collect())) == sorted(map(str, want.select("id", "p").collect()))


def test_exact_percentile(spark, skewed, many_segments):
    got = {r["g"]: r["p"] for r in O.order_statistics(skewed.filter("g is not null"), "v", ["id"], 0.7, ["g"], "p").collect()}
    want = {r["g"]: r["p"] for r in skewed.filter("g is not null").groupBy("g").agg(F.expr("percentile(v, 0.7)").alias("p")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_percentile_of_the_whole_table_and_of_null_groups(spark, skewed, many_segments):
    for share in (0.0, 0.31, 0.5, 1.0):
        want = skewed.agg(F.expr(f"percentile(v, {share})")).first()[0]
        assert abs(O.order_statistics(skewed, "v", ["id"], share, (), "p").first()["p"] - want) < 1e-9
    got = {r["g"]: r["p"] for r in O.order_statistics(skewed, "v", ["id"], 0.3, ["g"], "p").collect()}
    want = {r["g"]: r["p"] for r in skewed.groupBy("g").agg(F.expr("percentile(v, 0.3)").alias("p")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    none = skewed.filter("id < -1")
    assert O.order_statistics(none, "v", ["id"], 0.5, (), "p").first()["p"] is None
    assert O.order_statistics(none, "v", ["id"], 0.5, ["g"], "p").count() == 0


@pytest.mark.parametrize("rows", [0, 1, 200_000])
def test_shared_order_keys(spark, rows):
    """Five positions in each of many groups: few distinct keys, yet bounded cuts and right windows."""
    df = spark.range(rows).selectExpr("id div 5 as g", "id % 5 as pos", "id * 7 % 11 as v")
    cuts = O.cut_points(df, ["pos"])
    assert len(cuts) <= O.LEAST_SEGMENTS and cuts == sorted(set(cuts))
    got = O.previous_value(df, "v", ["pos"], ["g"], "p")
    want = df.withColumn("p", F.lag("v").over(W.partitionBy("g").orderBy("pos")))
    assert got.exceptAll(want).count() == 0 and got.count() == rows


def test_one_row_repeated(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id) as v", "1 as g")
    cuts = O.cut_points(df, ["v"])
    cells = O.with_segment(df, ["v"], cuts).groupBy(O.SEGMENT).count().orderBy(O.SEGMENT).collect()
    assert len(cells) >= 3 and max(r["count"] for r in cells[1:]) <= 2 * 30_000 / O.LEAST_SEGMENTS


def test_common_probe_grid(spark, many_segments):
    from sparkaudit.operators.timeline import asof_bracket

    frames = spark.range(2000).selectExpr("id % 200 as g", "double(id div 200) * 7 % 10 as t", "id as seq")
    probes = spark.range(200).selectExpr("id as g", "explode(sequence(0, 9)) as now")
    got = asof_bracket(probes, frames, ["g"]).select("g", "now", "prev.seq")
    before = probes.join(frames, "g").filter("t <= now").groupBy("g", "now").agg(F.max_by("seq", F.struct("t", "seq")).alias("seq"))
    want = probes.join(before, ["g", "now"], "left").select("g", "now", "seq")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_large_tables_never_meet_in_one_task(spark, skewed, many_segments):
    plan = O.ranked(skewed, ["v", "id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert windows and all("_segment" in line for line in windows)
