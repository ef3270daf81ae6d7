"""Signature labels whose thresholds come from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.labelling import MATRIX, SCORES, Z, sql
from cellgauge.catalog.registry import query
from cellgauge.operators.thresholds import score_by_found_thresholds

FOUND = f"""WITH {Z}, s AS ({' UNION ALL '.join(f"SELECT cell_id, '{t}' AS t, {e} AS s FROM z" for t, e in SCORES.items())}),
  g AS (SELECT t, x // 25 AS grp, round(avg(s), 9) AS y FROM s JOIN cells USING (cell_id) GROUP BY 1, 2),
  o AS (SELECT t, y, row_number() OVER (PARTITION BY t ORDER BY y, grp) AS i, count(*) OVER (PARTITION BY t) AS n FROM g),
  e AS (SELECT t, y, i, n, lead(y) OVER (PARTITION BY t ORDER BY i) AS above,
          regr_syy(y, i) OVER lo - coalesce(regr_sxy(y, i) OVER lo ** 2 / nullif(regr_sxx(y, i) OVER lo, 0), 0) AS e1,
          regr_syy(y, i) OVER hi - coalesce(regr_sxy(y, i) OVER hi ** 2 / nullif(regr_sxx(y, i) OVER hi, 0), 0) AS e2
        FROM o WINDOW lo AS (PARTITION BY t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY t ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  th AS (SELECT t, i AS below, n, (y + above) / 2 AS threshold FROM e WHERE i >= 3 AND n - i >= 3
         QUALIFY row_number() OVER (PARTITION BY t ORDER BY round(round(e1, 9) + round(e2, 9), 9), i) = 1)"""


def labelled(spark, sf):
    cells = fx.cells(spark, sf).withColumn("grp", F.floor(F.col("x") / 25))
    return score_by_found_thresholds(cells, MATRIX, "grp")


@query("c13_found_thresholds", sql(f"{FOUND} SELECT t AS type, round(threshold, 6) AS threshold, CAST(below AS INT) AS below, CAST(n AS INT) AS groups FROM th"))
def found_thresholds(spark, sf):
    return labelled(spark, sf)[1].withColumn("threshold", F.round("threshold", 6))


@query("c13_labels_by_found_thresholds", sql(f"""{FOUND}, b AS (SELECT cell_id, t FROM s JOIN th USING (t) WHERE s > threshold QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, t) = 1)
  SELECT cell_id, CASE WHEN t IS NULL OR t = 'Others' THEN 'undefined' ELSE t END AS predicted_phenotype FROM cells LEFT JOIN b USING (cell_id)"""))
def labels_by_found_thresholds(spark, sf):
    return labelled(spark, sf)[0].select("cell_id", "predicted_phenotype")
