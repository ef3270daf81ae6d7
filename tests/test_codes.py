"""Queries that code two keys in one number, on keys too large for their digits."""

import duckdb
from pyspark.sql import functions as F

from cellgauge.catalog import oracle_sql, queries
from cellgauge.catalog.check import compare
from tests.conftest import SF


def test_part_keys_of_seven_digits_match_the_sql(spark, tmp_path):
    name, con = "j14_attach_clusters", duckdb.connect()
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_partkey", F.col("l_partkey") + F.col("l_linenumber") * 700_000).write.parquet(str(tmp_path / "lineitem.parquet"))
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare(queries()[name](spark, str(tmp_path)).toPandas(), con.execute(oracle_sql()[name]).df()) is None
