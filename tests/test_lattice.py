import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkaudit.functions.numeric import draw_integer
from sparkaudit.operators import lattice as L
from sparkaudit.operators import sampling as P
from sparkaudit.plans.lattice import analyse, run_manifest, with_seed
from sparkaudit.sinks.lattices import write_lattices, write_manifests
from sparkaudit.sources import lattices as S


def entropy(tokens):
    n = len(tokens)
    return -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())


def matrix(spark, rows=20, cols=4, lattice=0):
    cells = [(lattice, r, c, f"t{(r * r + c * 3) % 7}xyz"[:5]) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(cells, "lattice_id int, r int, c int, token string"), cells


def test_files_round_trip(spark, scratch):
    words = [f"{chr(97 + i % 26)}abcd" for i in range(37)]
    with open(f"{scratch}/one.mat", "w") as f:
        f.write(" ".join(words[:20]) + " toolong xx\n " + "  ".join(words[20:]) + "\n")
    with open(f"{scratch}/two.mat", "w") as f:
        f.write("aaaaa bbbbb\n")
    cells = S.read_lattices(spark, scratch).cache()
    got = {r["lattice_id"][-7:]: r["n"] for r in cells.groupBy("lattice_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"one.mat": 32, "two.mat": 2}
    one = [r["token"] for r in cells.filter("lattice_id like '%one.mat'").orderBy("r", "c").collect()]
    assert one == words[:32]
    pool = S.read_token_pool(spark, scratch).orderBy("pool_index").collect()
    assert [r["pool_index"] for r in pool] == list(range(39)) and [r["token"] for r in pool[:37]] == words
    write_lattices(cells.withColumn("lattice_id", F.substring("lattice_id", -7, 3)), f"{scratch}/out")
    back = spark.read.text(f"{scratch}/out/lattice_id=one").collect()
    assert sorted(r[0] for r in back) == sorted([" ".join(words[:16]), " ".join(words[16:32])])


def test_large_file_in_many_splits(spark, scratch):
    words = [f"{i % 100000:05d}" for i in range(40_000)]
    with open(f"{scratch}/big.mat", "w") as f:
        f.write("\n".join(" ".join(words[i : i + 16]) for i in range(0, len(words), 16)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        tokens = S.read_token_pool(spark, scratch).orderBy("pool_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["token"] for r in tokens] == words


def test_entropy_bands_depth(spark):
    df, cells = matrix(spark)
    rows = {r["r"]: r["entropy"] for r in L.row_entropy(df).collect()}
    want = {r: entropy([t for _, x, _, t in cells if x == r]) for r in range(20)}
    assert all(abs(rows[r] - want[r]) < 1e-12 for r in want)
    whole = L.shannon_entropy(df, ["lattice_id"]).first()
    assert abs(whole["entropy"] - entropy([t for *_, t in cells])) < 1e-12
    bands = {r["band"]: r["mean_entropy"] for r in L.spectral_bands(L.row_entropy(df)).collect()}
    assert set(bands) == set(range(8))
    assert all(abs(bands[b] - (want[2 * b] + want[2 * b + 1]) / 2) < 1e-12 for b in range(8))
    top = analyse(df).first()
    assert top["dominant_band"] == max(range(8), key=lambda b: (round(bands[b], 12), -b)) and top["depth"] == 0.0
    short, _ = matrix(spark, rows=3)
    bands = [r["mean_entropy"] for r in L.spectral_bands(L.row_entropy(short)).orderBy("band").collect()]
    assert bands[3:] == [0.0] * 5
    assert L.shannon_entropy(df.filter("r < 0")).first()["entropy"] == 0.0


def test_fingerprint_and_seed(spark):
    df, cells = matrix(spark)
    other, more = matrix(spark, rows=3, lattice=1)
    want = {i: hashlib.blake2s(" ".join(t for *_, t in m).encode(), digest_size=8).hexdigest() for i, m in ((0, cells), (1, more))}
    rows = {r["lattice_id"]: r for r in with_seed(L.fingerprint(df.union(other).repartition(7)), "mutator").collect()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == want
    assert rows[0]["seed_int"] == int(hashlib.blake2s((want[0] + "mutator").encode(), digest_size=4).hexdigest(), 16)
    deep = L.tree_fingerprint(df, fan_in=4, levels=3).first()["fingerprint"]
    level = [hashlib.sha256(" ".join(t for _, x, _, t in cells if x == r).encode()).hexdigest() for r in range(20)]
    for _ in range(3):
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    assert [deep] == level


def test_delta_diagonal_set(spark):
    df, cells = matrix(spark)
    changed = L.validated_set(df, spark.createDataFrame([(0, 2, 1, "zzzzz")], df.schema))
    assert L.lattice_delta(df, changed).first()["delta"] == 1
    assert L.diagonal(df, 4, 1).count() == 20 and L.cell(df, 2, 1).count() == 1
    assert (L.row(df, 3).count(), L.column(df, 3).count()) == (4, 20)
    with pytest.raises(Exception, match="dimensions"):
        L.lattice_delta(df, df.filter("r < 19")).collect()
    with pytest.raises(Exception, match="exactly 5"):
        L.validated_set(df, spark.createDataFrame([(0, 2, 1, "zz")], df.schema)).collect()


def test_set_last_update_and_outside(spark):
    df, _ = matrix(spark)
    updates = spark.createDataFrame([(0, 2, 1, "aaaaa", 2), (0, 2, 1, "zzzzz", 1)], "lattice_id int, r int, c int, token string, at int")
    out = L.validated_set(df, updates, order="at")
    assert out.count() == df.count() and out.filter("r = 2 and c = 1").first()["token"] == "aaaaa"
    with pytest.raises(Exception, match="outside"):
        L.validated_set(df, updates.withColumn("r", F.lit(999))).collect()


def test_digests_beside_null_keys(spark):
    rows = [(9007199254740993, 0, "a"), (9007199254740992, 0, "b"), (None, 0, "c"), (None, 1, "d")]
    cells = spark.createDataFrame([(k, r, 0, t) for k, r, t in rows], "lattice_id bigint, r int, c int, token string")
    got = {r["lattice_id"] for r in L.fingerprint(cells).collect()}
    assert got == {9007199254740993, 9007199254740992, None} and L.fingerprint(cells).count() == 3


def test_tree_grows_to_one_node(spark):
    cells = spark.range(2500).selectExpr("1 as lattice_id", "int(id) as r", "0 as c", "'abcde' as token")
    assert L.tree_fingerprint(cells, fan_in=10, levels=1).count() == 1


def test_pools_and_draws(spark):
    pool = S.synthetic_pool(spark, 30)
    assert [r["token"] for r in pool.orderBy("pool_index").limit(2).collect()] == ["aaaaa", "aaaab"]
    assert pool.filter("pool_index = 27").first()["token"] == "aaabb"
    cells = P.generate_lattices(spark, 3, 4, 5, seed=1, pool=pool)
    assert cells.count() == 60 and cells.select("lattice_id", "r", "c").distinct().count() == 60
    assert sorted(map(str, cells.collect())) == sorted(map(str, P.generate_lattices(spark, 3, 4, 5, seed=1, pool=pool.repartition(3)).collect()))
    new, log = P.mutate_cells(cells, 7, 3, pool)
    assert log.groupBy("lattice_id").count().select("count").distinct().first()[0] == 7
    assert new.count() == 60 and L.lattice_delta(cells, new).agg(F.sum("delta")).first()[0] <= 21
    assert P.mutate_cells(cells, 100, 3, pool)[1].count() == 60
    assert P.generate_lattices(spark, 2, seed=9).count() == 512


def test_samples_and_weights(spark, many_segments):
    df = spark.range(3000)
    top = P.sample_n(df, ["id"], 5, 40)
    assert top.count() == 40 and P.sample_n(df, ["id"], 5, 9999).count() == 3000
    drawn = df.withColumn("d", draw_integer(5, F.col("id"))).orderBy("d", "id").limit(40)
    assert sorted(r["id"] for r in drawn.collect()) == sorted(r[0] for r in top.collect())
    same = df.withColumn("k", F.lit(1))  # one draw for all: the bound falls short and the whole table is ranked
    assert P.sample_n(same, ["k"], 5, 40).count() == 40 and P.sample_n(df, ["id"], 5, 0).count() == 0
    assert 1 <= P.sample_between(df, ["id"], 5, 1, 6).count() <= 6
    share = {r["label"]: r["count"] / 3000 for r in P.weighted_assign(df, ["id"], {"a": 3, "b": 1}, 2).groupBy("label").count().collect()}
    assert abs(share["a"] - 0.75) < 0.04


def test_manifests(spark, scratch):
    df, _ = matrix(spark)
    targets = P.distinct_targets([spark.createDataFrame([("x/a.py",), ("x/b.py",), ("x/skip.py",), ("x/a.py",)], "path string")], ["skip.py"])
    assert [r[0] for r in targets.collect()] == ["x/a.py", "x/b.py"]
    manifest = run_manifest(df, targets, 1775595414, 7)
    write_manifests(manifest, f"{scratch}/logs")
    back = S.read_run_manifests(spark, f"{scratch}/logs/run_date=2026-04-07")
    assert back.count() == 1 and 1 <= S.explode_actions(back).count() <= 2


def test_runs_give_the_results_of_cells(spark):
    texts = [" ".join(f"w{(i * i + d) % 11}" for i in range(n)) for d, n in enumerate((3, 16, 40, 200, 33, 0))]
    rows = [*enumerate(texts), (2, texts[3]), (2, texts[0]), (9, None)]
    docs = spark.createDataFrame(rows, "id int, text string")
    cells = S.text_lattices(docs, "id", "text", None)
    columns = S.text_lattice_runs(docs, "id", "text", None, along="c")
    wanted = {(r["id"], r["c"]): (r["n"], round(r["entropy"], 9)) for r in L.column_entropy(cells, "id").collect()}
    got = {(r["id"], r["c"]): (r["n"], round(r["entropy"], 9)) for r in L.column_entropy(columns, "id").collect()}
    assert got == wanted and len(got) > 60
    by_row = S.text_lattice_runs(docs, "id", "text", None)
    assert sorted(map(tuple, by_row.select("id", "r", F.posexplode("tokens")).collect())) == sorted(map(tuple, cells.collect()))
    turned = cells.withColumn("token", F.replace("token", F.lit("w1"), F.lit("x")))
    other = by_row.withColumn("tokens", F.transform("tokens", lambda t: F.replace(t, F.lit("w1"), F.lit("x"))))
    wanted = sorted(map(tuple, L.lattice_delta(cells, turned, "id").collect()))
    assert sorted(map(tuple, L.lattice_delta(by_row, other, "id").collect())) == wanted and sum(r[1] for r in wanted) > 40
    null = by_row.withColumn("id", F.lit(None).cast("int"))
    for wrong in (by_row.filter("r < 3"), by_row.withColumn("tokens", F.slice("tokens", 1, 9))):
        with pytest.raises(Exception, match="dimensions must match"):
            L.lattice_delta(by_row, wrong, "id").collect()
    with pytest.raises(Exception, match="dimensions must match"):
        L.lattice_delta(null, null, "id").collect()
