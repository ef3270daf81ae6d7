"""Views of the driver tables with the shapes the operators work on.

Each view exists twice: as a DataFrame and as the SQL of a common table
expression of the same name, for the reference queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# -- DataFrames ------------------------------------------------------------

LEVEL_2 = {"click": "browse", "view": "browse", "purchase": "convert", "signup": "convert", "error": "error"}
LEVEL_1 = {"browse": "activity", "convert": "activity", "error": "fault"}
CLASSES = ("click", "error", "purchase", "signup", "view")
MARKERS = ("m1", "m2", "m3")
METHODS = (("m_a", 1, 95), ("m_b", 3, 70), ("m_c", 5, 45))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


CELL_COLUMNS = (
    "event_id AS cell_id",
    "CAST(user_id % 20 AS STRING) AS sample_id",
    "(event_id * 7919) % 1000 AS x",
    "(event_id * 104729) % 997 AS y",
    "value AS m1",
    "CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS DOUBLE) AS m2",
    "CAST((event_id * 37) % 101 AS DOUBLE) AS m3",
    "event_type AS cell_type",
    """CASE WHEN event_type IN ('click','view') THEN 'browse'
            WHEN event_type IN ('purchase','signup') THEN 'convert' ELSE 'error' END AS level_2_cell_type""",
    "CASE WHEN event_type = 'error' THEN 'fault' ELSE 'activity' END AS level_1_cell_type",
)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Measured objects: id, sample, position, three markers, three label levels."""
    return table(spark, sf, "events").selectExpr(*CELL_COLUMNS)


PREDICTED = """
    CASE WHEN (cell_id * cell_id * 31 + cell_id * shift) % 101 < hits - 3 * (cell_id % 5) THEN
              CASE WHEN method = 'm_c' AND cell_type = 'error' THEN 'view' ELSE cell_type END
         WHEN cell_type = 'click' THEN 'view' WHEN cell_type = 'view' THEN 'purchase'
         WHEN cell_type = 'purchase' THEN 'signup' ELSE 'click' END AS predicted_phenotype"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of three methods in five folds, with the true labels of all levels."""
    methods = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(s).alias("shift"), F.lit(h).alias("hits")) for m, s, h in METHODS
    ])
    rows = cells(spark, sf).select("*", F.explode(methods).alias("_m")).select("*", "_m.*")
    return rows.selectExpr(
        "method", "cell_id % 5 AS fold", "cell_id", "sample_id", "cell_type AS true_phenotype",
        "level_2_cell_type", "level_1_cell_type", PREDICTED,
    )


def label_dim(spark: SparkSession, sf: str) -> DataFrame:
    from cellgauge.sources.tables import hierarchy_map

    return hierarchy_map(cells(spark, sf)).drop("n_variants")


def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestor lists of the class labels, as the label tree gives them."""
    return label_dim(spark, sf).select("label", F.array("level_1_cell_type", "level_2_cell_type").alias("ancestors"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr("vec_id", "vec_id % 5 AS fold", "label", "embedding")


EXPR_MARKERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def expr(spark: SparkSession, sf: str) -> DataFrame:
    """Marker values without a row key, for aggregates."""
    return table(spark, sf, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS sample_id", "l_returnflag AS cell_type", *EXPR_MARKERS
    )


def reannotated(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with an original and an optional corrected label."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return table(spark, sf, "labels").join(docs, "doc_id").selectExpr(
        "doc_id AS cell_id", "lang AS cell_labels", "CASE WHEN toxic = 1 THEN 'other' END AS new_label",
        "toxic = 1 AS reannotated", "CAST(quality AS DOUBLE) AS probability",
    )


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """Dataset metadata: platform and tissue of each customer."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).selectExpr("c_custkey", "c_mktsegment AS platform", "r_name AS tissue")


def time_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Timing text lines of several runs, with broken and repeated ones."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey % 3 AS run", "o_orderkey AS line",
        """CASE WHEN o_orderkey % 97 = 0 THEN 'note without number'
                WHEN o_orderkey % 89 = 0 THEN 'Fold 1: training_time: 3'
                ELSE concat('Fold ', CAST(o_orderkey % 5 + 1 AS STRING),
                     CASE WHEN o_orderkey % 2 = 0 THEN ' training_time: ' ELSE ' inference_time, ' END,
                     CAST(o_orderkey % 100 AS STRING),
                     CASE WHEN o_orderkey % 7 = 0 THEN ' seconds' WHEN o_orderkey % 7 = 1 THEN 's' ELSE '' END) END AS value""",
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A long pixel table with mask ids (0 is background) and two channels."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS sample_id", "l_partkey % 50 AS cell_id", "l_linenumber AS y", "CAST(l_quantity AS INT) AS x",
        "l_extendedprice AS price", "l_discount AS discount",
    )


# -- the same views in SQL -------------------------------------------------

CTE = {}

CTE["cells"] = (
    """SELECT event_id AS cell_id, CAST(user_id % 20 AS VARCHAR) AS sample_id,
       (event_id * 7919) % 1000 AS x, (event_id * 104729) % 997 AS y,
       value AS m1, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS DOUBLE) AS m2,
       CAST((event_id * 37) % 101 AS DOUBLE) AS m3, event_type AS cell_type,
       CASE WHEN event_type IN ('click','view') THEN 'browse'
            WHEN event_type IN ('purchase','signup') THEN 'convert' ELSE 'error' END AS level_2_cell_type,
       CASE WHEN event_type = 'error' THEN 'fault' ELSE 'activity' END AS level_1_cell_type
FROM events""",
    (),
)
CTE["preds"] = (
    f"""SELECT method, cell_id % 5 AS fold, cell_id, sample_id, cell_type AS true_phenotype,
       level_2_cell_type, level_1_cell_type, {PREDICTED}
FROM cells CROSS JOIN (SELECT 'm_a' AS method, 1 AS shift, 95 AS hits UNION ALL
                       SELECT 'm_b', 3, 70 UNION ALL SELECT 'm_c', 5, 45) m""",
    ("cells",),
)
CTE["expr"] = (
    """SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, l_returnflag AS cell_type,
       l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
    (),
)
CTE["exprlong"] = (
    """SELECT sample_id, cell_type, marker, value FROM expr
       UNPIVOT (value FOR marker IN (l_quantity, l_extendedprice, l_discount, l_tax))""",
    ("expr",),
)
CTE["cellslong"] = (
    """SELECT cell_id, sample_id, cell_type, marker, value
       FROM (SELECT cell_id, sample_id, cell_type, m1, m2, m3 FROM cells) UNPIVOT (value FOR marker IN (m1, m2, m3))""",
    ("cells",),
)
CTE["reann"] = (
    """SELECT l.doc_id AS cell_id, d.lang AS cell_labels, CASE WHEN toxic = 1 THEN 'other' END AS new_label,
       toxic = 1 AS reannotated, CAST(quality AS DOUBLE) AS probability
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    (),
)
CTE["meta"] = (
    """SELECT c_custkey, c_mktsegment AS platform, r_name AS tissue FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    (),
)
CTE["pixels"] = (
    """SELECT l_suppkey AS sample_id, l_partkey % 50 AS cell_id, l_linenumber AS y, CAST(l_quantity AS INT) AS x,
       l_extendedprice AS price, l_discount AS discount FROM lineitem""",
    (),
)
CTE["vecs"] = ("SELECT vec_id, vec_id % 5 AS fold, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings", ())


def with_ctes(sql: str, *names: str) -> str:
    """``sql`` behind the common table expressions it names, in dependency order."""
    wanted: list[str] = []

    def need(n: str) -> None:
        for dep in CTE[n][1]:
            need(dep)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        need(n)
    heads = ",\n".join(f"{n} AS ({CTE[n][0]})" for n in wanted)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {heads},\n{sql[5:]}"
    return f"WITH {heads}\n{sql}"


def r6(expr: str) -> str:
    """A double rounded to six digits, without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    names = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in names})
