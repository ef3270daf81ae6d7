"""The same results when nothing may be broadcast, and where staged tables go."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.functions.exprs import order_hash
from cellgauge.operators import cleaning as C
from cellgauge.operators import spatial as S
from cellgauge.operators import splits as K
from cellgauge.operators.ranks import exact_quantiles, hash_rank
from cellgauge.session import shared_dir, stage


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield spark
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.fixture(scope="module")
def rows(spark):
    g = F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5))
    return stage(spark.range(900).select("id", g.alias("g"), (F.col("id") % 37 * 1.5).alias("v"), (F.col("id") % 30).alias("x"), (F.col("id") % 29).alias("y")))


def no_bhj(df):
    df.collect()
    return "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_ranks_with_null_groups(no_broadcast, rows):
    ours = hash_rank(rows, ["g"], 3, ["id"], rank="r").select("id", "r")
    assert no_bhj(ours)
    plain = rows.select("id", F.row_number().over(W.partitionBy("g").orderBy(order_hash(3, "id"), "id")).cast("bigint").alias("r"))
    assert ours.exceptAll(plain).count() == 0 and ours.count() == 900


def test_quantiles(no_broadcast, rows):
    ours = exact_quantiles(rows, ["g"], "v", {"q": 0.3})
    assert no_bhj(ours)
    plain = rows.where("g is not null").groupBy("g").agg(F.percentile("v", F.lit(0.3)).alias("q"))
    assert {r.g: r.q for r in ours.collect()} == pytest.approx({r.g: r.q for r in plain.collect()})


def test_codes_and_folds(no_broadcast, rows):
    codes = C.category_codes(rows, "g")
    assert codes.where("g is null and code = -1").count() == 100 and codes.count() == 900
    assert K.stratified_kfold(rows.where("g is not null"), "g", ["id"], 4).groupBy("fold").count().count() == 4


def test_neighbours(spark, rows):
    def both():
        knn = S.knn_points(rows, rows, "g", "id", 4)
        near = S.radius_pairs(rows, "g", "id", 3.0, cell_rows=5)
        return sorted(map(tuple, knn.select("src", "dst", "rank").collect())), sorted(map(tuple, near.select("src", "dst").collect()))

    plain = both()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert both() == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def session(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert shared_dir(session("/shared/x", "yarn")) == "/shared/x"
    assert shared_dir(session(None, "local[2]")).startswith("/tmp/spark-")
    with pytest.raises(ValueError):
        shared_dir(session(None, "yarn"))
