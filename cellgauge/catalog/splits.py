"""Folds, validation splits, samples and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.fixtures import with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators import splits as K
from cellgauge.operators.crops import smallest_mask_window
from cellgauge.operators.ranks import hash_rank
from cellgauge.session import stage

SEED = 42
KEY = ["cell_id"]
H = f"md5(concat('{SEED}-', cell_id))"


def sql(body: str, *ctes: str) -> str:
    return with_ctes(body, *(ctes or ("cells",)))


def base(spark, sf, *more):
    return fx.cells(spark, sf).select("cell_id", "sample_id", "cell_type", *more)


CODED = """d AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS code FROM (SELECT DISTINCT cell_type FROM cells))"""


@query("k01_stratified_kfold", sql(f"""WITH {CODED} SELECT cell_id, cell_type,
  CAST((row_number() OVER (PARTITION BY cell_type ORDER BY {H}, cell_id) - 1 + code) % 5 AS INT) AS fold FROM cells JOIN d USING (cell_type)"""))
def stratified(spark, sf):
    return K.stratified_kfold(base(spark, sf), "cell_type", KEY, 5, SEED).select("cell_id", "cell_type", "fold")


@query("k02_stratified_group_kfold", sql(f"""WITH {CODED}, n AS (SELECT sample_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2),
  g AS (SELECT sample_id, sum(n)::BIGINT AS rows_in, max_by(cell_type, (n, cell_type)) AS main FROM n GROUP BY 1),
  s AS (SELECT *, length(bin(rows_in)) * 8 + (rows_in >> greatest(length(bin(rows_in)) - 3, 0)) AS size FROM g),
  f AS (SELECT sample_id, CAST((row_number() OVER (PARTITION BY main, size ORDER BY md5(concat('{SEED}-', sample_id)), sample_id) - 1 + code + size) % 5 AS INT) AS fold
        FROM s JOIN d ON d.cell_type = s.main)
  SELECT cell_id, sample_id, cell_type, fold FROM cells JOIN f USING (sample_id)"""))
def group_kfold(spark, sf):
    return K.stratified_group_kfold(base(spark, sf), "cell_type", "sample_id", KEY, 5, SEED)


@query("k02_balanced_group_kfold", sql("SELECT cell_id, true AS whole, true AS as_even_as_dealt, true AS even FROM cells"))
def balanced_group_kfold(spark, sf):
    """Groups are whole; the largest deviation of a class from an equal share is at most that of dealt groups, and below the largest group's share of the class."""
    rows = base(spark, sf)
    ours, dealt = stage(K.balanced_group_kfold(rows, "cell_type", "sample_id", KEY, 5, SEED), "ours"), stage(K.stratified_group_kfold(rows, "cell_type", "sample_id", KEY, 5, SEED), "dealt")

    def worst(df):
        n = df.groupBy("cell_type", "fold").count().groupBy("cell_type").agg((F.max("count") / F.sum("count")).alias("top"))
        return n.agg(F.max("top").alias("w")).select("w").scalar()

    group = ours.groupBy("sample_id", "cell_type").count().groupBy("cell_type").agg((F.max("count") / F.sum("count")).alias("g")).agg(F.max("g").alias("g")).select("g").scalar()
    whole = ours.groupBy("sample_id").agg((F.countDistinct("fold") == 1).alias("whole"))
    return ours.join(whole, "sample_id").select("cell_id", "whole", (worst(ours) <= worst(dealt)).alias("as_even_as_dealt"), (worst(ours) <= F.lit(0.2) + group).alias("even"))


@query("k02_group_kfold_fallback", sql(f"""WITH {CODED} SELECT cell_id,
  CAST((row_number() OVER (PARTITION BY cell_type ORDER BY {H}, cell_id) - 1 + code) % 5 AS INT) AS fold FROM cells JOIN d USING (cell_type)"""))
def group_fallback(spark, sf):
    # three groups cannot fill five folds
    df = base(spark, sf, "level_2_cell_type")
    return K.stratified_group_kfold(df, "cell_type", "level_2_cell_type", KEY, 5, SEED).select("cell_id", "fold")


@query("k03_group_shuffle_split", sql(f"""WITH g AS (SELECT rep, sample_id FROM (SELECT DISTINCT sample_id FROM cells), range(4) r(rep)),
  o AS (SELECT CAST(rep AS INT) AS rep, sample_id, row_number() OVER (PARTITION BY rep ORDER BY md5(concat('{SEED}-', rep, '-', sample_id))) AS r,
        count(*) OVER (PARTITION BY rep) AS n FROM g)
  SELECT rep, cell_id, CASE WHEN r <= ceil(0.5 * n) THEN 'test' ELSE 'train' END AS split FROM cells JOIN o USING (sample_id)"""))
def group_shuffle(spark, sf):
    df = base(spark, sf)
    return df.join(K.group_shuffle_split(df, "sample_id", 4, 0.5, SEED), "sample_id").select("rep", "cell_id", "split")


@query("k03_shuffle_split", sql(f"""WITH o AS (SELECT CAST(rep AS INT) AS rep, cell_id, row_number() OVER (PARTITION BY rep ORDER BY md5(concat('{SEED}-', rep, '-', cell_id))) AS r,
    count(*) OVER (PARTITION BY rep) AS n FROM cells, range(2) g(rep))
  SELECT rep, cell_id, CASE WHEN r <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS split FROM o"""))
def shuffle(spark, sf):
    return K.group_shuffle_split(base(spark, sf), "cell_id", 2, 0.3, SEED)


@query("k04_swap_train_test", sql("SELECT cell_id, CASE WHEN cell_id % 5 = 0 THEN 'train' ELSE 'test' END AS split FROM cells"))
def swap(spark, sf):
    df = base(spark, sf).select("cell_id", F.when(F.col("cell_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return K.swap_train_test(df)


@query("k05_validation_split", sql(f"""WITH f AS (SELECT cell_id, cell_id % 3 AS fold,
    CASE WHEN cell_id = 4 THEN 'lonely' ELSE cell_type END AS cell_type, CASE WHEN cell_id % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM cells),
  c AS (SELECT fold, min(n) < 2 AS lone FROM (SELECT fold, cell_type, count(*) AS n FROM f WHERE split = 'train' GROUP BY 1, 2) GROUP BY 1),
  t AS (SELECT f.*, lone, CASE WHEN lone THEN '*' ELSE cell_type END AS st FROM f JOIN c USING (fold) WHERE split = 'train'),
  r AS (SELECT *, row_number() OVER (PARTITION BY fold, st ORDER BY {H}, cell_id) AS r, count(*) OVER (PARTITION BY fold, st) AS n FROM t)
  SELECT cell_id, fold, cell_type, CASE WHEN r <= CASE WHEN lone THEN ceil(0.15 * n) ELSE round(0.15 * n) END THEN 'validation' ELSE 'train' END AS split FROM r
  UNION ALL SELECT cell_id, fold, cell_type, split FROM f WHERE split = 'test'"""))
def validation(spark, sf):
    df = base(spark, sf).select(
        "cell_id", (F.col("cell_id") % 3).alias("fold"), F.when(F.col("cell_id") == 4, "lonely").otherwise(F.col("cell_type")).alias("cell_type"),
        F.when(F.col("cell_id") % 7 == 0, "test").otherwise("train").alias("split"))
    return K.validation_split(df, "cell_type", KEY, ["fold"], 0.15, SEED)


@query("k06_sample_n", sql(f"SELECT cell_id, cell_type FROM cells QUALIFY row_number() OVER (ORDER BY {H}, cell_id) <= 777"))
def sample_n(spark, sf):
    return K.sample_n(base(spark, sf), 777, KEY, SEED).select("cell_id", "cell_type")


@query("k06_sample_fraction", sql(f"""SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY {H}, cell_id) AS r, count(*) OVER () AS n FROM cells)
  WHERE r <= round(0.4 * n)"""))
def sample_fraction(spark, sf):
    return K.sample_fraction(base(spark, sf), 0.4, KEY, SEED).select("cell_id")


@query("k07_sample_images", sql(f"""WITH s AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat('{SEED}-', sample_id))) AS r, count(*) OVER () AS n
    FROM (SELECT DISTINCT sample_id FROM cells))
  SELECT cell_id, sample_id FROM cells WHERE sample_id IN (SELECT sample_id FROM s WHERE r <= greatest(round(0.2 * n), 1))"""))
def sample_images(spark, sf):
    return K.sample_groups(base(spark, sf), "sample_id", 0.2, SEED).select("cell_id", "sample_id")


GRID = """sz AS (SELECT sample_id, (max(x) + 1) // 100 AS nc, (max(y) + 1) // 100 AS nr FROM cells GROUP BY 1),
  wn AS (SELECT sample_id, wx AS win_x, wy AS win_y FROM (SELECT sample_id, unnest(range(nc)) AS wx, nr FROM sz), LATERAL (SELECT unnest(range(nr)) AS wy)),
  cn AS (SELECT sample_id, x // 100 AS win_x, y // 100 AS win_y, count(*) AS n FROM cells GROUP BY 1, 2, 3),
  gr AS (SELECT sample_id, win_x, win_y, coalesce(n, 0) AS n_cells FROM wn LEFT JOIN cn USING (sample_id, win_x, win_y))"""


@query("k08_grid_windows", sql(f"""WITH {GRID} SELECT * FROM gr
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat('{SEED}-', sample_id, '-', win_x, '-', win_y))) <= 10"""))
def grid(spark, sf):
    return K.grid_windows(fx.cells(spark, sf), "sample_id", 100, 100, 10, SEED)


NEAR = """SELECT {c}.sample_id, {c}.cx, {c}.cy, greatest(abs(x - {c}.cx), abs(y - {c}.cy)) AS d,
    row_number() OVER (PARTITION BY {c}.sample_id ORDER BY greatest(abs(x - {c}.cx), abs(y - {c}.cy))) AS r FROM cells JOIN {c} ON cells.sample_id = {c}.sample_id"""


@query("k09_smallest_window", sql(f"""WITH ce AS (SELECT sample_id, x AS cx, y AS cy FROM cells QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {H}, cell_id) = 1),
  a AS ({NEAR.format(c='ce')}), b AS (SELECT sample_id, cx, cy, d FROM a WHERE r = 25),
  mv AS (SELECT sample_id, greatest(least(cx, 1000 - d), least(d, 500.0)) AS cx, greatest(least(cy, 1000 - d), least(d, 500.0)) AS cy FROM b),
  e AS ({NEAR.format(c='mv')}), f AS (SELECT sample_id, cx, cy, d FROM e WHERE r = 25)
  SELECT f.sample_id, CAST(f.cx AS DOUBLE) AS cx, CAST(f.cy AS DOUBLE) AS cy, CAST(2 * f.d AS DOUBLE) AS side, count(*) AS n_cells FROM f JOIN e ON e.sample_id = f.sample_id AND e.d <= f.d GROUP BY ALL"""))
def window(spark, sf):
    cells = fx.cells(spark, sf)
    centres = K.cap_per_class(cells, "sample_id", KEY, 1, SEED).selectExpr("sample_id", "CAST(x AS DOUBLE) AS cx", "CAST(y AS DOUBLE) AS cy")
    return K.smallest_window(cells, centres, "sample_id", 25, 1000, 1000)


@query("k09_window_of_all", sql(f"""WITH ce AS (SELECT sample_id, x AS cx, y AS cy FROM cells QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {H}, cell_id) = 1),
  a AS ({NEAR.format(c='ce')}), b AS (SELECT sample_id, cx, cy, max(d) AS d FROM a GROUP BY ALL),
  mv AS (SELECT sample_id, greatest(least(cx, 1000 - d), least(d, 500.0)) AS cx, greatest(least(cy, 1000 - d), least(d, 500.0)) AS cy FROM b),
  e AS ({NEAR.format(c='mv')})
  SELECT sample_id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, CAST(2 * max(d) AS DOUBLE) AS side, count(*) AS n_cells FROM e GROUP BY ALL"""))
def window_of_all(spark, sf):
    # more points asked for than any sample has
    cells = fx.cells(spark, sf)
    centres = K.cap_per_class(cells, "sample_id", KEY, 1, SEED).selectExpr("sample_id", "CAST(x AS DOUBLE) AS cx", "CAST(y AS DOUBLE) AS cy")
    return K.smallest_window(cells, centres, "sample_id", 2**30, 1000, 1000)


# a mask of blocks with gaps: a third of each image's pixels may stand anywhere, so boxes overlap
MASK = """mk AS (SELECT l_suppkey AS sample_id, CAST(l_quantity AS BIGINT) - 1 AS x, l_orderkey % 50 AS y,
    CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 3 = 0 THEN 1 + l_partkey % 40 ELSE 1 + (l_orderkey % 50) // 5 * 10 + (CAST(l_quantity AS BIGINT) - 1) // 5 END AS cell_id FROM lineitem),
  ce AS (SELECT sample_id, x AS cx, y AS cy FROM (SELECT DISTINCT sample_id, x, y FROM mk WHERE cell_id <> 0)
    QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat('{SEED}-', sample_id, '-', x, '-', y)), x, y) <= 3)"""
SIZED = """{to}0 AS (SELECT c.sample_id, c.from_x, c.from_y, c.cx, c.cy, cell_id, min(greatest(c.cx - x, x - c.cx + 1, c.cy - y, y - c.cy + 1)) AS half
    FROM {of} c JOIN mk ON mk.sample_id = c.sample_id WHERE cell_id <> 0 GROUP BY ALL),
  {to}1 AS (SELECT *, row_number() OVER (PARTITION BY sample_id, from_x, from_y ORDER BY half) AS r, count(*) FILTER (half <= 25) OVER (PARTITION BY sample_id, from_x, from_y) AS reached FROM {to}0),
  {to} AS (SELECT sample_id, from_x, from_y, cx, cy, CASE WHEN max(reached) >= {m} THEN 2 * max(half) FILTER (r = {m}) ELSE 50 END AS side FROM {to}1 GROUP BY ALL)"""


def mask_pixels(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS sample_id", "CAST(l_quantity AS BIGINT) - 1 AS x", "l_orderkey % 50 AS y",
        """CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 3 = 0 THEN 1 + l_partkey % 40
           ELSE 1 + (l_orderkey % 50) div 5 * 10 + (CAST(l_quantity AS BIGINT) - 1) div 5 END AS cell_id""")


def mask_windows(spark, sf, m):
    pixels = mask_pixels(spark, sf)
    on = pixels.where("cell_id <> 0").select("sample_id", "x", "y").distinct()
    centres = hash_rank(on, ["sample_id"], SEED, ["sample_id", "x", "y"], rank="_rank", first=3).selectExpr("sample_id", "x AS cx", "y AS cy")
    return smallest_mask_window(pixels, centres, "sample_id", "cell_id", m, 50, 50)


def mask_sql(m):
    return f"""WITH {MASK.format(SEED=SEED)}, c0 AS (SELECT sample_id, cx AS from_x, cy AS from_y, cx, cy FROM ce),
  {SIZED.format(to='a', of='c0', m=m)}, mv AS (SELECT sample_id, from_x, from_y, least(greatest(cx, side // 2), 50 - side // 2) AS cx, least(greatest(cy, side // 2), 50 - side // 2) AS cy FROM a),
  {SIZED.format(to='b', of='mv', m=m)}
  SELECT b.sample_id, b.from_x, b.from_y, b.cx, b.cy, CAST(b.side AS BIGINT) AS side, count(*) AS n_cells FROM b JOIN b0 USING (sample_id, from_x, from_y) WHERE half <= b.side // 2 GROUP BY ALL"""


@query("k09_mask_window", mask_sql(12))
def mask_window(spark, sf):
    return mask_windows(spark, sf, 12)


@query("k09_mask_window_of_all", mask_sql(200))
def mask_window_of_all(spark, sf):
    # more mask ids asked for than any image has
    return mask_windows(spark, sf, 200)


@query("k10_internal_validation", sql(f"""WITH c AS (SELECT cell_id, cell_type FROM cells QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY {H}, cell_id) <= 500),
  d AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS code FROM (SELECT DISTINCT cell_type FROM c))
  SELECT cell_id, CASE WHEN (row_number() OVER (PARTITION BY cell_type ORDER BY {H}, cell_id) - 1 + code) % 4 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM c JOIN d USING (cell_type)"""))
def internal(spark, sf):
    return K.first_stratified_fold(base(spark, sf), "cell_type", KEY, 0.25, SEED, cap=500).select("cell_id", "split")


@query("k11_cap_per_class", sql(f"SELECT cell_id, cell_type FROM cells QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY {H}, cell_id) <= 1000"))
def cap(spark, sf):
    return K.cap_per_class(base(spark, sf), "cell_type", KEY, 1000, SEED).select("cell_id", "cell_type")


@query("k12_overlapping_windows", sql("""WITH s AS (SELECT unnest(list_distinct(list_append([i * 112 FOR i IN range(0, (1000 - 224) // 112 + 1)], 776))) AS s),
  t AS (SELECT unnest(list_distinct(list_append([i * 112 FOR i IN range(0, (997 - 224) // 112 + 1)], 773))) AS s),
  e AS (SELECT sample_id, s.s AS x0, t.s AS y0, cell_type FROM cells JOIN s ON x >= s.s AND x < s.s + 224 JOIN t ON y >= t.s AND y < t.s + 224)
  SELECT sample_id, x0, y0, count(*) AS n_cells FROM e GROUP BY 1, 2, 3"""))
def overlapping(spark, sf):
    w = K.overlapping_windows(fx.cells(spark, sf), 224, 1000, 997)
    return w.groupBy("sample_id", "x0", "y0").agg(F.count(F.lit(1)).alias("n_cells"))
