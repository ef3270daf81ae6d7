"""Readers and writers, by way of files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators.metrics import confusion_counts
from cellgauge.session import scratch_path
from cellgauge.sources import tables as S

CELLS = "cell_id bigint, sample_id string, x bigint, y bigint, m1 double, m2 double, m3 double, cell_type string"
NAMES = [c.split()[0] for c in CELLS.split(", ")]


@query("s01_read_quant", with_ctes("SELECT cell_id, sample_id, x, y, m1, nullif(m2, 5) AS m2, m3, cell_type FROM cells", "cells"))
def read_quant(spark, sf):
    path = scratch_path(spark, "quant")
    nan = F.when(F.col("m2") == 5, F.lit(float("nan"))).otherwise(F.col("m2"))
    fx.cells(spark, sf).withColumn("m2", nan).select(*NAMES).write.option("header", True).csv(path)
    return S.read_quant(spark, path, CELLS)


@query("s01_quant_to_parquet", with_ctes("SELECT cell_id, sample_id, m1 FROM cells WHERE m1 > 20", "cells"))
def quant_to_parquet(spark, sf):
    path = scratch_path(spark, "quant")
    fx.cells(spark, sf).select(*NAMES).write.option("header", True).csv(path)
    return S.quant_to_parquet(spark, path, scratch_path(spark, "quant_parquet"), CELLS).where("m1 > 20").select("cell_id", "sample_id", "m1")


@query("s02_read_predictions", with_ctes(
    """SELECT 'tissue_a' AS dataset, method, 'level3' AS level, CAST(fold AS VARCHAR) AS fold, cell_id, true_phenotype, predicted_phenotype FROM preds""", "preds"))
def read_predictions(spark, sf):
    path = scratch_path(spark, "results")
    preds = fx.predictions(spark, sf).select(
        F.lit("tissue_a").alias("dataset"), "method", F.lit("level3").alias("level"),
        F.concat(F.lit("predictions_"), "fold", F.lit(".csv")).alias("file"), "cell_id", "true_phenotype", "predicted_phenotype")
    preds.hint("rebalance", "method", "file").write.option("header", True).partitionBy("dataset", "method", "level", "file").csv(path)
    return S.read_predictions(spark, path, "cell_id bigint, true_phenotype string, predicted_phenotype string", folders=True)


@query("s02_mixed_layouts", with_ctes(
    """SELECT CASE WHEN cell_id % 2 = 0 THEN 'tissue_a' ELSE 'tissue_b' END AS dataset, method, CAST(fold AS VARCHAR) AS fold, cell_id, true_phenotype, predicted_phenotype,
       CASE WHEN method = 'm_b' THEN (cell_id % 10) / 10.0 END AS confidence FROM preds""", "preds"))
def read_mixed_layouts(spark, sf):
    # one root; each method's files have columns and an order of their own
    path = scratch_path(spark, "results")
    layouts = {"m_a": ["cell_id", "true_phenotype", "predicted_phenotype"], "m_b": ["predicted_phenotype", "confidence", "cell_id", "true_phenotype"], "m_c": ["true_phenotype", "predicted_phenotype", "cell_id"]}
    preds = fx.predictions(spark, sf).withColumn("confidence", F.col("cell_id") % 10 / 10)
    folder = F.when(F.col("cell_id") % 2 == 0, "tissue_a").otherwise("tissue_b")
    for method, columns in layouts.items():
        part = preds.where(F.col("method") == method).select(
            folder.alias("dataset"), "method", F.lit("level3").alias("level"), F.concat(F.lit("predictions_"), "fold", F.lit(".csv")).alias("file"), *columns)
        part.hint("rebalance", "dataset", "file").write.mode("append").option("header", True).partitionBy("dataset", "method", "level", "file").csv(path)
    out = S.read_predictions(spark, path, "cell_id bigint, true_phenotype string, predicted_phenotype string, confidence double", folders=True)
    return out.drop("level")


@query("s03_concat_files", with_ctes(
    """SELECT sample_id, cell_id, m1, NULL::DOUBLE AS m2 FROM cells WHERE cell_type <> 'error'
       UNION ALL SELECT sample_id, cell_id, m1, m2 FROM cells WHERE cell_type = 'error'""", "cells"))
def concat_files(spark, sf):
    first, second = scratch_path(spark, "narrow"), scratch_path(spark, "wide")
    df = fx.cells(spark, sf)
    df.where("cell_type <> 'error'").select("sample_id", "cell_id", "m1").write.option("header", True).partitionBy("sample_id").csv(first)
    df.where("cell_type = 'error'").select("sample_id", "cell_id", "m1", "m2").write.option("header", True).partitionBy("sample_id").csv(second)
    out = S.concat_files(spark, [first], "cell_id bigint, m1 double", folders=True).unionByName(
        S.concat_files(spark, second, "cell_id bigint, m1 double, m2 double", folders=True), allowMissingColumns=True)
    return out.select("sample_id", "cell_id", "m1", "m2")


def _times_sql() -> str:
    from cellgauge.catalog.leaderboard import TIMES

    return TIMES + "SELECT CAST(run AS VARCHAR) AS run, fold, event, seconds FROM times"


@query("s04_read_fold_times", _times_sql())
def read_fold_times(spark, sf):
    path = scratch_path(spark, "times")
    lines = fx.time_lines(spark, sf)
    # range partitions keep the line order over the part files of a run
    lines.repartitionByRange("run", "line").sortWithinPartitions("run", "line").select("run", "value").write.partitionBy("run").text(path)
    return S.read_fold_times(spark, path, folders=True)


@query("s05_read_cell_folds", """SELECT c_nationkey::BIGINT AS random_state, CAST(f AS INT) AS fold,
    CASE WHEN c_custkey % 5 = f THEN 'test' WHEN c_custkey % 5 = (f + 1) % 5 THEN 'validation' ELSE 'train' END AS split, c_custkey AS row
  FROM customer, range(5) r(f)""")
def read_cell_folds(spark, sf):
    path = scratch_path(spark, "folds")
    df = fx.table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    at = F.col("c_custkey") % 5

    def rows(cond):
        return F.collect_list(F.when(cond, F.col("c_custkey")))

    test, val = at == F.col("fold"), at == (F.col("fold") + 1) % 5
    lists = df.groupBy("c_nationkey", "fold").agg(rows(~test & ~val).alias("train"), rows(test).alias("test"), rows(val).alias("validation"))
    docs = lists.groupBy(F.col("c_nationkey").alias("random_state")).agg(
        F.collect_list(F.struct("fold", "train", "test", "validation")).alias("folds"))
    docs.select(F.to_json(F.struct("random_state", "folds")).alias("value")).write.text(path)
    return S.read_cell_folds(spark, path)


@query("s06_read_image_folds", """SELECT CAST(f AS INT) AS fold, CASE WHEN s_suppkey % 5 = f THEN 'test' ELSE 'train' END AS split, s_name AS image
  FROM supplier, range(5) r(f)""")
def read_image_folds(spark, sf):
    path = scratch_path(spark, "image_folds")
    df = fx.table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    split = F.when(F.col("s_suppkey") % 5 == F.col("fold"), "test").otherwise("train")
    named = df.select("s_nationkey", F.concat(F.lit("fold_"), "fold", F.lit("_"), split, F.lit("_set")).alias("name"), "s_name")
    sets = named.groupBy("s_nationkey", "name").agg(F.collect_list("s_name").alias("images"))
    docs = sets.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("name", "images"))).alias("m"))
    docs.select(F.to_json("m").alias("value")).write.text(path)
    return S.read_image_folds(spark, path, multiline=False)


@query("s07_read_line_labels", with_ctes(
    """WITH n AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY cell_id) AS pos, CAST(m3 AS INT) - 1 AS code FROM cells),
       s AS (SELECT sample_id, count(*) AS c FROM cells GROUP BY 1),
       d AS (SELECT sample_id, c, CASE CAST(sample_id AS INT) % 3 WHEN 0 THEN c WHEN 1 THEN c - 1 ELSE c + 2 END AS cells FROM s),
       e AS (SELECT sample_id, c, cells, unnest(range(1, cells + 1)) AS cell_id FROM d)
       SELECT e.sample_id, e.cell_id, coalesce(code, -1) AS code FROM e
       LEFT JOIN n ON n.sample_id = e.sample_id AND n.pos = e.cell_id + CASE WHEN c = cells + 1 THEN 1 ELSE 0 END""", "cells"))
def read_line_labels(spark, sf):
    path = scratch_path(spark, "labels")
    cells = fx.cells(spark, sf)
    lines = cells.select("sample_id", "cell_id", (F.col("m3").cast("int") - 1).cast("string").alias("value"))
    lines.repartitionByRange("sample_id", "cell_id").sortWithinPartitions("sample_id", "cell_id").select(
        "sample_id", "value").write.partitionBy("sample_id").text(path)
    # samples with as many lines as cells, with a background line, and with missing lines
    kind = F.col("sample_id").cast("int") % 3
    shift = F.when(kind == 0, 0).when(kind == 1, -1).otherwise(2)
    sizes = cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("c")).select("sample_id", (F.col("c") + shift).alias("n_cells"))
    return S.read_line_labels(spark, path, sizes, folders=True)


@query("s07_remapped_line_labels", with_ctes(
    """WITH n AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY cell_id) AS pos, CAST(m3 AS INT) - 1 AS code FROM cells)
       SELECT sample_id, pos AS cell_id, CASE WHEN code IN (3, 50) THEN -1 ELSE code END AS code FROM n""", "cells"))
def remapped_line_labels(spark, sf):
    # sizes are known for a few samples only
    path = scratch_path(spark, "labels")
    cells = fx.cells(spark, sf)
    cells.select("sample_id", "cell_id", (F.col("m3").cast("int") - 1).cast("string").alias("value")).repartitionByRange(
        "sample_id", "cell_id").sortWithinPartitions("sample_id", "cell_id").select("sample_id", "value").write.partitionBy("sample_id").text(path)
    sizes = cells.where("sample_id < '15'").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return S.read_line_labels(spark, path, sizes, folders=True, unlabelled=[3, 50])


@query("s08_read_decision_matrix", """SELECT p_brand AS cell_type, p_type AS marker,
    CAST(CASE WHEN max(p_size) >= 49 THEN 1 WHEN min(p_size) <= 4 THEN -1 ELSE 0 END AS DOUBLE) AS weight
  FROM part GROUP BY 1, 2 HAVING count(*) % 4 <> 0""")
def read_decision_matrix(spark, sf):
    path = scratch_path(spark, "matrix")
    part = fx.table(spark, sf, "part")
    weight = F.when(F.max("p_size") >= 49, 1).when(F.min("p_size") <= 4, -1).otherwise(0)
    types = [r[0] for r in part.select("p_type").distinct().orderBy("p_type").collect()]
    part.groupBy(F.col("p_brand").alias("Populations")).pivot("p_type", types).agg(
        F.when(F.count(F.lit(1)) % 4 != 0, weight)).write.option("header", True).csv(path)
    return S.read_decision_matrix(spark, path)


@query("s09_read_hierarchy", """WITH last AS (SELECT p_name, max(concat(p_type, '|', p_brand)) AS path FROM part GROUP BY 1)
  SELECT p_partkey, p_name, concat(split_part(path, '|', 1), ' > ', split_part(path, '|', 2)) AS ancestors FROM part JOIN last USING (p_name)""")
def read_hierarchy(spark, sf):
    path = scratch_path(spark, "tree")
    part = fx.table(spark, sf, "part")
    nodes = part.select("p_type", "p_brand", "p_name").distinct().select(F.explode(F.array(
        F.struct("p_type", F.lit("").alias("b"), F.lit("").alias("n"), F.col("p_type").alias("value")),
        F.struct("p_type", F.col("p_brand").alias("b"), F.lit("").alias("n"), F.concat(F.lit("  "), "p_brand").alias("value")),
        F.struct("p_type", F.col("p_brand").alias("b"), F.col("p_name").alias("n"), F.concat(F.lit("    "), "p_name").alias("value")),
        F.struct("p_type", F.lit("~").alias("b"), F.lit("").alias("n"), F.lit("").alias("value")),
    )).alias("l")).select("l.*").distinct()
    nodes.orderBy("p_type", "b", "n").select("value").write.text(path)
    tree = S.read_hierarchy(spark, path)
    return part.join(tree, part["p_name"] == tree["label"]).select(
        "p_partkey", "p_name", F.array_join("ancestors", " > ").alias("ancestors"))


@query("s09_hierarchy_map", """WITH c AS (SELECT p_name AS label, p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, p_brand, p_type) AS k, count(*) OVER (PARTITION BY label) AS n_variants FROM c)
  SELECT label, p_brand, p_type, n_variants FROM r WHERE k = 1""")
def hierarchy_map(spark, sf):
    return S.hierarchy_map(fx.table(spark, sf, "part"), "p_name", ["p_brand", "p_type"])


@query("s10_write_csv", with_ctes(
    "SELECT method, true_phenotype AS true_label, predicted_phenotype AS pred_label, count(*) AS n FROM preds GROUP BY 1, 2, 3", "preds"))
def write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    S.write_csv(confusion_counts(fx.predictions(spark, sf), ["method"]), path)
    return spark.read.option("header", True).option("sep", ";").schema("method string, true_label string, pred_label string, n bigint").csv(path)


@query("s11_write_predictions", with_ctes(
    "SELECT cell_id, true_phenotype, predicted_phenotype, method, CAST(fold AS INT) AS fold FROM preds", "preds"))
def write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    preds = fx.predictions(spark, sf).withColumns({"dataset": F.lit("tissue_a"), "level": F.lit("level_3")})
    S.write_predictions(preds, path)
    return spark.read.parquet(path).where("dataset = 'tissue_a' AND level = 'level_3'").select(
        "cell_id", "true_phenotype", "predicted_phenotype", "method", "fold")


@query("s12_embeddings", f"""SELECT vec_id, label, len(embedding) AS dims, {r6('list_sum(CAST(embedding AS DOUBLE[]))')} AS total FROM embeddings""")
def embeddings(spark, sf):
    path = scratch_path(spark, "embeddings")
    S.write_embeddings(fx.vectors(spark, sf).withColumnRenamed("label", "image"), path)
    out = S.read_embeddings(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rounded(out.select("vec_id", F.col("image").alias("label"), F.size("embedding").cast("bigint").alias("dims"), total.alias("total")))


@query("s13_write_folds", with_ctes("""SELECT cell_id, cell_type, m1, CAST(f AS INT) AS fold, CASE WHEN cell_id % 5 = f THEN 'test' ELSE 'train' END AS split FROM cells, range(5) r(f)""", "cells"))
def write_folds(spark, sf):
    path = scratch_path(spark, "fold_tables")
    df = fx.cells(spark, sf).select("cell_id", "cell_type", "m1", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    S.write_folds(df.withColumn("split", F.when(F.col("cell_id") % 5 == F.col("fold"), "test").otherwise("train")), path)
    return spark.read.parquet(path).select("cell_id", "cell_type", "m1", "fold", "split")
