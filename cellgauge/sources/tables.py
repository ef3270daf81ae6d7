"""Readers and writers of measurement, prediction, fold and embedding tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.functions.exprs import base_stem
from cellgauge.operators.cleaning import expand_range, nan_to_null

# -- measurement tables ----------------------------------------------------


def read_quant(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A measurement CSV; NaN becomes null, ``sample_id`` text and ``cell_id`` bigint.

    A given schema must name the columns of the header in their order, else reading fails.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    casts = {c: F.col(c).cast(t) for c, t in (("sample_id", "string"), ("cell_id", "bigint")) if c in df.columns}
    return nan_to_null(df.withColumns(casts) if casts else df)


def sample_of(path: str | Column, folders: bool = False) -> Column:
    """The sample a file belongs to: its stem, or its folder (``name`` or ``key=name``)."""
    path = F.col(path) if isinstance(path, str) else path
    if not folders:
        return base_stem(path)
    return F.regexp_extract(path, r"(?:[^/=]+=)?([^/=]+)/[^/]+$", 1)


def concat_files(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, folders: bool = False
) -> DataFrame:
    """Many CSV files as one table, the file stem (or the folder) as ``sample_id``.

    Several paths may have different columns; missing ones are filled with null.
    """
    parts = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for p in parts:
        reader = spark.read.option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True)
        df = reader.schema(schema).csv(p) if schema is not None else reader.option("inferSchema", True).csv(p)
        df = df.withColumn("sample_id", sample_of(F.col("_metadata.file_path"), folders))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def quant_to_parquet(spark: SparkSession, csv_path: str, path: str, schema: T.StructType | str) -> DataFrame:
    """Convert a measurement CSV once; later reads prune columns and push filters down."""
    read_quant(spark, csv_path, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _write_foldered(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """A Parquet folder per value of ``by``.

    Rebalancing brings the rows of a folder together, so that the number of files
    does not grow with tasks times folders; a folder with many rows is split.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


# -- predictions -----------------------------------------------------------


def _files_by_header(spark: SparkSession, roots: str | Sequence[str], glob: str | None = None) -> list[list[str]]:
    """The paths of the files below the roots as Spark writes them, one list per first line; empty files are left out.

    Paths alone reach the driver, as in any listing; first lines are found
    in the files' first blocks.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text([roots] if isinstance(roots, str) else list(roots)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"))
    found = heads.groupBy("head").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("head").collect()
    return [row.files for row in found]


def read_predictions(
    spark: SparkSession, roots: str | Sequence[str], schema: T.StructType | str, folders: bool = False
) -> DataFrame:
    """All ``<dataset>/<method>/<level>/predictions_<fold>.csv`` files below the roots.

    Columns are found by the name in each file's own header and cast to
    ``schema``; one that a file lacks is null. Files with the same header are
    read together. With ``folders`` a prediction file is a folder of part files,
    and path parts may be written ``key=value``. Paths are taken apart once per
    file; rows get the parts by a join on the path.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    part = r"(?:[^/=]+=)?([^/]+)/"
    pattern = re.compile(part * 3 + r"(?:[^/=]+=)?predictions_?([^/]*?)\.csv(?:/[^/]+)?$")
    names = ("dataset", "method", "level", "fold")
    parts_ddl = ", ".join(f"{n} string" for n in ("_file", *names))
    out = spark.createDataFrame([], T.StructType([*wanted, *(T.StructField(n, T.StringType()) for n in names)]))
    for files in _files_by_header(spark, roots, None if folders else "predictions*.csv"):
        fitting = [(f, *m.groups()) for f in files if (m := pattern.search(f))]
        if not fitting:
            continue
        raw = spark.read.option("header", True).csv([unquote(f) for f, *_ in fitting])
        rows = raw.select(
            F.col("_metadata.file_path").alias("_file"),
            *[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted],
        )
        # the list of paths is at the driver as it is
        out = out.unionByName(rows.join(F.broadcast(spark.createDataFrame(fitting, parts_ddl)), "_file").drop("_file"))
    return out


def write_predictions(df: DataFrame, path: str, by: Sequence[str] = ("dataset", "method", "level", "fold")) -> None:
    """One folder per dataset, method, level and fold; readers prune by them."""
    _write_foldered(df, path, by)


# -- timings ---------------------------------------------------------------


def parse_fold_times(lines: DataFrame, by: Sequence[str] = (), order: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``Fold i event: seconds`` lines as ``fold, event, seconds``.

    A comma may stand for the colon, a unit may follow the number; lines that do
    not have exactly two parts are skipped. Of a repeated event the last line by
    ``order`` counts.
    """
    parts = F.split(F.replace(F.trim(value), F.lit(","), F.lit(":")), ":")
    name = F.trim(parts[0])
    first = F.split(F.trim(parts[1]), r"\s+")[0]
    number = F.regexp_extract(first, r"^([-+0-9.eE]+?)s?$", 1).try_cast("double")
    words = F.split(name, " ", 3)
    rows = lines.where((F.trim(value) != "") & (F.size(parts) == 2)).select(
        *by, *order, name.alias("_name"), F.get(words, F.lit(1)).alias("fold"), F.get(words, F.lit(2)).alias("event"),
        number.alias("seconds"),
    )
    if not order:
        return rows.drop("_name")
    last = F.max_by(F.struct("fold", "event", "seconds"), F.struct(*order))
    return rows.groupBy(*by, "_name").agg(last.alias("_r")).select(*by, "_r.*")


def read_fold_times(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Timing text files of any number of runs; ``run`` is the file stem or its folder."""
    lines = number_lines(spark, path).withColumn("run", sample_of("file", folders))
    return parse_fold_times(lines, by=["run"], order=["file", "block", "line"])


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a position: file, start of the file block, and order in it.

    Works for files of any size, as no file is read as one value.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


# -- folds -----------------------------------------------------------------


FOLD_LISTS = "fold:int,train:array<bigint>,test:array<bigint>,validation:array<bigint>"


def read_cell_folds(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Nested row-index lists as ``random_state, fold, split, row``; one document per line or file."""
    schema = f"random_state bigint, folds array<struct<{FOLD_LISTS}>>"
    raw = spark.read.schema(schema).option("multiLine", multiline).json(path)
    folds = raw.select("random_state", F.explode("folds").alias("f")).select("random_state", "f.*")
    lists = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("rows")) for s in ("train", "test", "validation")])
    return folds.select("random_state", "fold", F.explode(lists).alias("l")).select(
        "random_state", "fold", "l.split", F.explode("l.rows").alias("row")
    )


def read_image_folds(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``fold_i_train_set`` / ``fold_i_test_set`` lists as ``fold, split, image``.

    One document per file, or per line with ``multiline`` off.
    """
    text = spark.read.text(path, wholetext=multiline)
    entries = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "images"))
    pattern = r"^fold_([0-9]+)_(train|test|validation)_set$"
    return entries.where(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).cast("int").alias("fold"),
        F.regexp_extract("name", pattern, 2).alias("split"),
        F.explode("images").alias("image"),
    )


def write_folds(df: DataFrame, path: str) -> None:
    """One table for all folds and splits; a reader of one fold reads only its folder."""
    _write_foldered(df, path, ("fold", "split"))


# -- labels per line -------------------------------------------------------


def read_line_labels(
    spark: SparkSession, path: str, n_cells: DataFrame | None = None, folders: bool = False, unlabelled: Sequence[int] = ()
) -> DataFrame:
    """One label code per line, line N for cell N: ``sample_id, cell_id, code``.

    ``n_cells`` (``sample_id, n_cells``) tells how many cells each sample has: a
    file with one line more starts with an entry for the background, which is
    dropped; a shorter file is padded with -1. Samples that ``n_cells`` lacks
    keep all their lines. Codes in ``unlabelled`` become -1.
    """
    lines = number_lines(spark, path).where(F.trim("value") != "").withColumn("sample_id", sample_of("file", folders))
    # position of a line = lines in earlier blocks of the sample + its rank in the block
    block = ["sample_id", "file", "block"]
    counts = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("sample_id").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        *block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy("sample_id")).alias("_lines"),
    )
    in_block = F.row_number().over(W.partitionBy(*block).orderBy("line"))
    rows = lines.join(counts, block).select(
        "sample_id", (F.col("_before") + in_block).alias("_pos"), "_lines",
        F.trim("value").cast("double").cast("int").alias("code"),
    )
    if unlabelled:
        rows = rows.withColumn("code", F.when(F.col("code").isin(list(unlabelled)), F.lit(-1)).otherwise(F.col("code")))
    if n_cells is None:
        return rows.select("sample_id", F.col("_pos").alias("cell_id"), "code")
    sizes = n_cells.select("sample_id", F.col("n_cells").cast("bigint").alias("_cells"))
    shift = F.when(F.col("_lines") == F.col("_cells") + 1, 1).otherwise(0)
    known = rows.join(sizes, "sample_id", "left").withColumn("cell_id", F.col("_pos") - F.coalesce(shift, F.lit(0)))
    placed = known.where("_cells is not null").select("sample_id", "cell_id", "code")
    unknown = known.where("_cells is null").select("sample_id", "cell_id", "code")
    every = expand_range(sizes.where(F.col("_cells") > 0), F.lit(1), F.col("_cells"), "cell_id").drop("_cells")
    padded = every.join(placed, ["sample_id", "cell_id"], "left").select(
        "sample_id", "cell_id", F.coalesce("code", F.lit(-1)).alias("code")
    )
    return padded.unionByName(unknown)


# -- decision matrices, label trees ---------------------------------------


def read_decision_matrix(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A wide type x marker CSV as ``cell_type, marker, weight`` without empty entries."""
    wide = spark.read.option("header", True).csv(path)
    name = name or wide.columns[0]
    long = wide.unpivot([name], [c for c in wide.columns if c != name], "marker", "weight")
    return long.select(F.col(name).alias("cell_type"), "marker", F.col("weight").try_cast("double").alias("weight")).where(
        F.col("weight").isNotNull()
    )


def parse_label_tree(
    lines: DataFrame, by: Sequence[str], order: Sequence[str], strict: bool = True, value: str = "value", max_depth: int = 16
) -> DataFrame:
    """An indented tree (two blanks per level) as ``label, ancestors``.

    ``lines`` carries the tree id ``by`` and the line order. Labels of the first
    two levels have no entry; of a label that occurs twice the last line counts.
    ``strict`` skips blank lines and takes as ancestors only lines that are
    indented less. Otherwise a blank line resets the path, and lines indented
    too far hang below the first of them.

    A tree lists classes, not rows, so it is ordered in one window per tree.
    """
    text = F.col(value)
    rows = lines.where(F.trim(text) != "") if strict else lines
    indent = F.length(text) - F.length(F.ltrim(text))
    rows = rows.select(
        *by, F.trim(text).alias("label"), F.floor(indent / 2).cast("int").alias("_level"),
        F.row_number().over(W.partitionBy(*by).orderBy(*order)).alias("_i"),
    )
    seq = W.partitionBy(*by).orderBy("_i")
    before = seq.rowsBetween(W.unboundedPreceding, -1)
    place = F.col("_level")
    if not strict:
        # the path grows by at most one entry per line: a line's place in it is a running minimum
        slack = F.when(F.col("_i") == 1, F.lit(0)).otherwise(F.col("_level")) - F.col("_i")
        rows = rows.withColumn("_depth", F.col("_i") + F.min(slack).over(seq.rowsBetween(W.unboundedPreceding, W.currentRow)))
        place = F.col("_depth")
    last = {
        f"_p{d}": F.last(F.when(place == d, F.struct("_i", "label")), ignorenulls=True).over(before)
        for d in range(max_depth)
    }
    rows = rows.withColumns(last)
    if strict:
        # an earlier line is an ancestor while no line after it is indented less
        alive, top = [], F.lit(0)
        for d in range(max_depth):
            p = F.col(f"_p{d}")
            alive.append(F.when((F.col("_level") > d) & (p["_i"] > top), p["label"]))
            top = F.greatest(top, F.coalesce(p["_i"], F.lit(0)))
        ancestors = F.array_compact(F.array(*alive))
        wanted = F.size("ancestors") >= 2
    else:
        ancestors = F.slice(F.array(*[F.col(f"_p{d}")["label"] for d in range(max_depth)]), 1, F.col("_depth"))
        wanted = F.col("_level") >= 2
    entries = rows.withColumn("ancestors", ancestors).where(wanted)
    return entries.groupBy(*by, "label").agg(F.max_by("ancestors", "_i").alias("ancestors"))


def read_hierarchy(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A label tree text file (or folder of part files in order) as ``label, ancestors``."""
    lines = number_lines(spark, path).withColumn("tree", F.lit(0))
    return parse_label_tree(lines, ["tree"], ["file", "block", "line"], strict).drop("tree")


def hierarchy_map(quant: DataFrame, label: str = "cell_type", levels: Sequence[str] = ("level_2_cell_type", "level_1_cell_type")) -> DataFrame:
    """Level labels of every fine label, the most frequent combination winning.

    Columns ``label``, the levels, and ``n_variants`` (above 1 is a conflict).
    """
    combos = quant.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), *levels).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct(*levels), F.struct(-F.col("_n"), *levels))
    return combos.groupBy("label").agg(best.alias("_b"), F.count(F.lit(1)).alias("n_variants")).select("label", "_b.*", "n_variants")


# -- embeddings ------------------------------------------------------------


def write_embeddings(df: DataFrame, path: str, image: str = "image") -> None:
    """Vectors and their metadata in one table, a folder per image."""
    _write_foldered(df, path, (image,))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# -- marker names ----------------------------------------------------------
