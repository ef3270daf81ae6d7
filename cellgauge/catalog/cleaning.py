"""Column selection, label cleaning and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.functions import exprs as E
from cellgauge.operators import cleaning as C
from cellgauge.operators.ranks import exact_quantiles


def sql(body: str, *ctes: str) -> str:
    return with_ctes(body, *(ctes or ("cells",)))


@query("p01_drop_cols", sql("SELECT * EXCLUDE (x, y, m3) FROM cells"))
def drop_cols(spark, sf):
    return C.drop_cols(fx.cells(spark, sf), ["x", "y", "m3", "not_there"])


@query("p02_rename", sql("SELECT cell_id AS object_id, sample_id AS image, cell_type AS class FROM cells"))
def rename(spark, sf):
    df = fx.cells(spark, sf).select("cell_id", "sample_id", "cell_type")
    return C.rename(df, {"cell_id": "object_id", "sample_id": "image", "cell_type": "class"})


@query("p03_reorder", sql("SELECT cell_id, cell_type, sample_id, m1 FROM cells"))
def reorder(spark, sf):
    df = fx.cells(spark, sf).select("cell_id", "sample_id", "m1", "cell_type")
    return C.reorder(C.reorder(df, "cell_type", "cell_id"), "m1", "absent")


@query("p04_split_columns", sql("SELECT cell_id, m1, m2, m3 FROM cells"))
def split_columns(spark, sf):
    df = fx.cells(spark, sf).select("m1", "m2", "m3", "cell_id", "cell_type")
    markers, _ = C.split_columns(df, "cell_id")
    return df.select("cell_id", *markers)


@query("p05_numeric_only", sql("SELECT cell_id, x, y, m1, m2, m3, sample_id FROM cells"))
def numeric_only(spark, sf):
    return C.numeric_only(fx.cells(spark, sf), keep=["sample_id"])


def holes(spark, sf):
    """Cells with nulls in two markers."""
    return fx.cells(spark, sf).select(
        "cell_id", F.nullif("m2", F.lit(5.0)).alias("m2"), F.nullif("m3", F.lit(7.0)).alias("m3"), "cell_type"
    )


HOLES = "holes AS (SELECT cell_id, nullif(m2, 5) AS m2, nullif(m3, 7) AS m3, cell_type FROM cells)"


@query("p06_drop_nulls", sql(f"WITH {HOLES} SELECT * FROM holes WHERE m2 IS NOT NULL AND m3 IS NOT NULL"))
def drop_nulls(spark, sf):
    return C.drop_nulls(holes(spark, sf))


@query("p07_impute", sql(f"WITH {HOLES} SELECT cell_id, coalesce(m2, -1.0) AS m2, coalesce(m3, -1.0) AS m3 FROM holes"))
def impute(spark, sf):
    return C.impute(holes(spark, sf).select("cell_id", "m2", "m3"), -1.0)


@query("p08_to_numeric_coerce", """SELECT CAST(TRY_CAST(t AS DOUBLE) AS BIGINT) AS code, n FROM (
  SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 1 THEN concat(o_orderkey, '.0') ELSE CAST(o_orderkey AS VARCHAR) END AS t,
         o_custkey AS n FROM orders) WHERE TRY_CAST(t AS DOUBLE) IS NOT NULL""")
def to_numeric(spark, sf):
    df = fx.table(spark, sf, "orders").selectExpr(
        """CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 1 THEN concat(o_orderkey, '.0')
                ELSE CAST(o_orderkey AS STRING) END AS code""", "o_custkey AS n")
    return C.to_numeric_coerce(df, "code")


@query("p09_harmonise_labels", sql("""SELECT cell_id, CASE cell_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click'
  WHEN 'error' THEN 'undefined' ELSE cell_type END AS cell_type FROM cells"""))
def harmonise(spark, sf):
    df = fx.cells(spark, sf).select("cell_id", "cell_type")
    return C.harmonise_labels(df, "cell_type", {"click": "view", "view": "click", "error": "undefined"})


@query("p09_harmonise_by_table", """SELECT o_orderkey, coalesce(s_name, CAST(o_custkey AS VARCHAR)) AS label
  FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""")
def harmonise_table(spark, sf):
    df = fx.table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS STRING) AS label")
    mapping = fx.table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS old", "s_name AS new")
    return C.harmonise_labels(df, "label", mapping)


@query("p10_derive_levels", sql("SELECT cell_id, cell_type, level_2_cell_type, level_1_cell_type FROM cells"))
def derive_levels(spark, sf):
    return C.derive_levels(fx.cells(spark, sf).select("cell_id", "cell_type"), fx.LEVEL_2, fx.LEVEL_1)


@query("p11_replace_substr", """SELECT p_partkey, replace(p_name, ' ', '_') AS name,
  regexp_replace(p_brand, '#[0-9]+', '', 'g') AS brand FROM part""")
def replace_substr(spark, sf):
    return fx.table(spark, sf, "part").select(
        "p_partkey", E.replace_text("p_name", " ", "_").alias("name"), E.replace_text("p_brand", "#[0-9]+", "", regex=True).alias("brand"))


@query("p12_stem_all", """SELECT page_id, regexp_replace(regexp_replace(concat(url, '/img_', page_id, '.ome.tiff'), '^.*/', ''), '^(.+?)\\..*$', '\\1') AS stem FROM pages""")
def stem_all(spark, sf):
    name = F.concat("url", F.lit("/img_"), "page_id", F.lit(".ome.tiff"))
    return fx.table(spark, sf, "pages").select("page_id", E.base_stem(name).alias("stem"))


@query("p13_relabel_if_contains", """SELECT n, CASE WHEN lower(l) LIKE '%other%' OR lower(l) LIKE '%undefined%' THEN 'undefined' ELSE l END AS label
  FROM (SELECT p_partkey AS n, CASE p_size % 4 WHEN 0 THEN concat('OTHER_', p_type) WHEN 1 THEN 'Undefined cell' WHEN 2 THEN NULL ELSE p_type END AS l FROM part)""")
def relabel(spark, sf):
    df = fx.table(spark, sf, "part").selectExpr(
        "p_partkey AS n",
        "CASE p_size % 4 WHEN 0 THEN concat('OTHER_', p_type) WHEN 1 THEN 'Undefined cell' WHEN 2 THEN NULL ELSE p_type END AS label")
    return df.select("n", E.relabel_if_contains("label", ["other", "undefined"], "undefined").alias("label"))


@query("p14_yes_no_to_int", "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS flag FROM orders")
def yes_no(spark, sf):
    df = fx.table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END AS answer")
    return df.select("o_orderkey", E.yes_no_to_int("answer").alias("flag"))


@query("p15_ensure_true_label", sql("SELECT cell_id, cell_type, cell_type AS true_phenotype FROM cells"))
def ensure_true(spark, sf):
    return C.ensure_true_label(fx.cells(spark, sf).select("cell_id", "cell_type"))


@query("p16_exclude_values", sql("""SELECT cell_id, cell_type FROM (SELECT cell_id, nullif(cell_type, 'signup') AS cell_type FROM cells)
  WHERE cell_type IS NULL OR cell_type NOT IN ('error', 'view')"""))
def exclude(spark, sf):
    df = fx.cells(spark, sf).select("cell_id", F.nullif("cell_type", F.lit("signup")).alias("cell_type"))
    return C.exclude_values(df, "cell_type", ["error", "view"])


@query("p17_keep_values", sql("SELECT cell_id, cell_type FROM cells WHERE cell_type IN ('error', 'view')"))
def keep(spark, sf):
    return C.keep_values(fx.cells(spark, sf).select("cell_id", "cell_type"), "cell_type", ["error", "view"])


@query("p18_bin_out_of_vocab", with_ctes("""SELECT method, cell_id, true_phenotype, CASE WHEN predicted_phenotype IN
  (SELECT true_phenotype FROM preds WHERE true_phenotype <> 'view' AND true_phenotype <> 'click') OR predicted_phenotype = 'click'
  THEN predicted_phenotype ELSE 'Other' END AS predicted_phenotype FROM preds WHERE true_phenotype NOT IN ('view', 'click')""", "preds"))
def bin_vocab(spark, sf):
    preds = C.exclude_values(fx.predictions(spark, sf), "true_phenotype", ["view", "click"])
    return C.bin_out_of_vocab(preds, "true_phenotype", "predicted_phenotype", ["click"]).select(
        "method", "cell_id", "true_phenotype", "predicted_phenotype")


@query("p19_drop_rare_classes", """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN
  (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 25.0 FROM customer))""")
def drop_rare(spark, sf):
    df = fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return C.drop_rare_classes(df, "c_nationkey", df.select(F.count(F.lit(1)) / 25.0).scalar())


@query("p20_drop_outlier_rows", sql("""SELECT count(*) AS n, """ + ", ".join(
    f"{r6(f'sum(CAST({m} AS DECIMAL(20, 2)))')} AS sum_{m}" for m in fx.EXPR_MARKERS) + """ FROM expr, (SELECT """ + ", ".join(
    f"quantile_cont({m}, 0.99) AS q_{m}" for m in fx.EXPR_MARKERS) + " FROM expr) WHERE " + " AND ".join(
    f"{m} <= q_{m}" for m in fx.EXPR_MARKERS), "expr"))
def drop_outliers(spark, sf):
    kept = C.drop_outlier_rows(fx.expr(spark, sf), fx.EXPR_MARKERS, 0.99)
    # whole numbers of hundredths keep the sum independent of its order
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(m).cast("decimal(20,2)")).alias(f"sum_{m}") for m in fx.EXPR_MARKERS]),
                   *[f"sum_{m}" for m in fx.EXPR_MARKERS])


@query("p20_one_low_outlier", """WITH v AS (SELECT l_orderkey, CASE WHEN l_orderkey = 1 THEN -1e9 ELSE l_extendedprice END AS v FROM lineitem)
  SELECT round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.99), 6) AS high FROM v""")
def outlier(spark, sf):
    v = F.when(F.col("l_orderkey") == 1, F.lit(-1e9)).otherwise(F.col("l_extendedprice"))
    found = exact_quantiles(fx.table(spark, sf, "lineitem").select(F.lit(1).alias("g"), v.alias("v")), ["g"], "v", {"low": 0.01, "mid": 0.5, "high": 0.99})
    return found.select(*[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query("p21_dedup_keep_first", """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2""")
def dedup(spark, sf):
    df = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return C.dedup_keep_first(df, ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("p22_dense_reindex", """WITH r AS (SELECT o_custkey % 10 AS sample_id, o_custkey // 10 AS cell_id, max(o_orderpriority) AS label
    FROM orders GROUP BY 1, 2),
  ids AS (SELECT sample_id, unnest(range(1, top + 1)) AS cell_id FROM (SELECT sample_id, max(cell_id) AS top FROM r GROUP BY 1) WHERE top >= 1)
  SELECT sample_id, cell_id, coalesce(label, '') AS label, label IS NULL AS _is_dummy FROM ids LEFT JOIN r USING (sample_id, cell_id)""")
def reindex(spark, sf):
    df = fx.table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % 10).alias("sample_id"), F.floor(F.col("o_custkey") / 10).alias("cell_id")
    ).agg(F.max("o_orderpriority").alias("label"))
    return C.dense_reindex(df, ["sample_id"], "cell_id", {"label": ""})


@query("p22_given_range", """WITH r AS (SELECT o_custkey % 10 AS sample_id, o_custkey // 10 AS cell_id, max(o_orderpriority) AS label
    FROM orders WHERE o_custkey % 10 < 8 GROUP BY 1, 2),
  n AS (SELECT DISTINCT o_custkey % 10 AS sample_id, o_custkey % 10 * 7 + 3 AS top FROM orders),
  ids AS (SELECT sample_id, unnest(range(1, top + 1)) AS cell_id FROM n)
  SELECT sample_id, cell_id, coalesce(label, '') AS label, label IS NULL AS _is_dummy FROM ids LEFT JOIN r USING (sample_id, cell_id)""")
def reindex_given(spark, sf):
    # sizes come from elsewhere, and name samples without any row
    orders = fx.table(spark, sf, "orders").withColumn("sample_id", F.col("o_custkey") % 10)
    df = orders.where("sample_id < 8").groupBy("sample_id", F.floor(F.col("o_custkey") / 10).alias("cell_id")).agg(F.max("o_orderpriority").alias("label"))
    sizes = orders.select("sample_id", (F.col("sample_id") * 7 + 3).alias("last")).distinct()
    return C.dense_reindex(df, ["sample_id"], "cell_id", {"label": ""}, last=sizes)


@query("p23_effective_label", sql("SELECT cell_id, coalesce(nullif(new_label, ''), cell_labels) AS label FROM reann", "reann"))
def effective(spark, sf):
    return fx.reannotated(spark, sf).select("cell_id", E.effective_label("new_label", "cell_labels").alias("label"))


@query("p24_filter_low_confidence", sql("""SELECT cell_id, cell_labels FROM reann
  WHERE coalesce(CASE WHEN cell_id % 3 = 0 THEN NULL ELSE probability END, 1.0) <= 0.5 AND cell_labels = 'en'""", "reann"))
def low_confidence(spark, sf):
    df = fx.reannotated(spark, sf).withColumn("probability", F.when(F.col("cell_id") % 3 != 0, F.col("probability")))
    return C.filter_low_confidence(df, "probability", 0.5, "cell_labels", "en").select("cell_id", "cell_labels")


@query("p25_category_codes", sql("""WITH lab AS (SELECT cell_id, nullif(cell_type, 'signup') AS cell_type FROM cells),
  d AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS code FROM (SELECT DISTINCT cell_type FROM lab WHERE cell_type <> 'error'))
  SELECT cell_id, lab.cell_type, CAST(coalesce(code, -1) AS INT) AS code FROM lab LEFT JOIN d ON d.cell_type = lab.cell_type"""))
def codes(spark, sf):
    df = fx.cells(spark, sf).select("cell_id", F.nullif("cell_type", F.lit("signup")).alias("cell_type"))
    return C.category_codes(df, "cell_type", excluded=["error"])


@query("p26_compact_codes", sql("""WITH s AS (SELECT cell_id, cell_type, CASE cell_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
    FROM cells WHERE NOT (cell_type = 'error' AND cell_id % 5 >= 2)),
  d AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS code FROM (SELECT DISTINCT cell_type FROM s WHERE split = 'train'))
  SELECT cell_id, split, CAST(coalesce(code, -9) AS INT) AS code, coalesce(d.cell_type, '?') AS restored
  FROM s LEFT JOIN d USING (cell_type) WHERE code IS NOT NULL OR split = 'test'"""))
def compact(spark, sf):
    split = F.when(F.col("cell_id") % 5 == 0, "test").when(F.col("cell_id") % 5 == 1, "validation").otherwise("train")
    df = fx.cells(spark, sf).select("cell_id", "cell_type", split.alias("split")).where(
        ~((F.col("cell_type") == "error") & (F.col("cell_id") % 5 >= 2)))
    coded = C.compact_codes(df, "cell_type", "split")
    names = C.label_dictionary(df.where("split = 'train'"), "cell_type")
    out = C.restore_labels(coded, "code", names, "restored")
    return out.select("cell_id", "split", F.coalesce("code", F.lit(-9)).alias("code"), F.coalesce("restored", F.lit("?")).alias("restored"))


@query("p27_tile_coordinates", sql("""SELECT cell_id, CAST(y + 1000 * CAST(sample_id AS INT) AS DOUBLE) AS x, x AS y FROM cells"""))
def tile(spark, sf):
    from cellgauge.operators.spatial import tile_coordinates

    df = fx.cells(spark, sf).select("cell_id", "x", "y", F.col("sample_id").cast("int").alias("image_code"))
    return tile_coordinates(df, "image_code").drop("image_code")


@query("p28_missing_rate", sql(f"""WITH {HOLES}, r AS (SELECT avg(CASE WHEN m2 IS NULL THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN m3 IS NULL THEN 1.0 ELSE 0 END) AS b FROM holes)
  SELECT 'm2' AS "column", {r6('a')} AS rate FROM r UNION ALL SELECT 'm3', {r6('b')} FROM r UNION ALL SELECT '*', {r6('(a + b) / 2')} FROM r"""))
def missing(spark, sf):
    return rounded(C.missing_rate(holes(spark, sf), ["m2", "m3"]))


@query("p29_check_features", sql("SELECT cell_id, m1, m2, m3 FROM cells"))
def check(spark, sf):
    return C.check_features(fx.cells(spark, sf).select("cell_id", *fx.MARKERS), fx.MARKERS)


@query("p30_unknown_filter", sql("""SELECT cell_id, label FROM (SELECT cell_id, CASE WHEN m3 < 10 THEN 'Unknown' WHEN m3 < 20 THEN NULL ELSE cell_type END AS label FROM cells)
  WHERE label IS NOT NULL AND label <> 'Unknown'"""))
def unknown(spark, sf):
    df = fx.cells(spark, sf).select("cell_id", F.when(F.col("m3") < 10, "Unknown").when(F.col("m3") >= 20, F.col("cell_type")).alias("label"))
    return C.drop_unknown(df, "label")


@query("p31_parse_prob_vector", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST([l_discount, l_tax, l_quantity / 100] AS DOUBLE[]) AS v FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(list_position(v, list_max(v)) - 1 AS INT) AS best, list_max(v) AS confidence FROM p""")
def prob_vector(spark, sf):
    text = F.concat(F.lit("["), F.concat_ws(", ", F.col("l_discount").cast("string"), F.col("l_tax").cast("string"),
                                            (F.col("l_quantity") / 100).cast("string")), F.lit("]"))
    df = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("prob_list"))
    v = E.parse_vector("prob_list")
    return df.withColumn("v", v).select(
        "l_orderkey", "l_linenumber", "l_partkey", E.argmax("v").alias("best"), F.array_max("v").alias("confidence"))


@query("p32_composite_key", sql("SELECT cell_id, concat(sample_id, '_', cell_id) AS key FROM cells"))
def key(spark, sf):
    return fx.cells(spark, sf).select("cell_id", E.composite_key("sample_id", "cell_id").alias("key"))
