"""Column selection, label cleaning and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.functions.exprs import isin_or_null_false, replace_exact
from cellgauge.operators.ranks import exact_quantiles
from cellgauge.session import stage

# -- columns ---------------------------------------------------------------


def drop_cols(df: DataFrame, names: Iterable[str], ignore_missing: bool = True) -> DataFrame:
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing and not ignore_missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def reorder(df: DataFrame, name: str, after: str | int) -> DataFrame:
    """Move a column behind another one, or to a position; unchanged if either is absent."""
    if name not in df.columns or (isinstance(after, str) and after not in df.columns):
        return df
    rest = [c for c in df.columns if c != name]
    at = after if isinstance(after, int) else rest.index(after) + 1 if after in rest else len(rest)
    return df.select(*rest[:at], name, *rest[at:])


def split_columns(df: DataFrame, sentinel: str, inclusive: bool = False) -> tuple[list[str], list[str]]:
    """Marker columns and observation columns on either side of a named column."""
    at = df.columns.index(sentinel) + (1 if inclusive else 0)
    return df.columns[:at], df.columns[at:]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns in their order, then the ``keep`` columns that are not numeric."""
    numeric = numeric_columns(df)
    return df.select(*numeric, *[k for k in keep if k in df.columns and k not in numeric])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def ensure_true_label(
    df: DataFrame, target: str = "true_phenotype", source: str = "cell_type", rename_source: bool = False
) -> DataFrame:
    """Make sure the true-label column exists, from the class column if it does not."""
    if target in df.columns:
        return df
    return df.withColumnRenamed(source, target) if rename_source else df.withColumn(target, F.col(source))


# -- values ----------------------------------------------------------------


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


def impute(df: DataFrame, value: float, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(cols) if cols else None)


def to_numeric_coerce(df: DataFrame, name: str) -> DataFrame:
    """Read a text column as whole numbers; rows that do not parse are dropped."""
    number = F.col(name).try_cast("double")
    return df.withColumn(name, number).where(F.col(name).isNotNull()).withColumn(name, F.col(name).cast("bigint"))


def harmonise_labels(df: DataFrame, name: str, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace whole labels; a mapping table has columns ``old`` and ``new``."""
    if not isinstance(mapping, DataFrame):
        return df.withColumn(name, replace_exact(name, mapping))
    dim = mapping.select(F.col("old").alias(name), F.col("new").alias("_new"))
    out = df.join(dim, name, "left").withColumn(name, F.coalesce("_new", name))
    return out.select(*df.columns)


def derive_levels(
    df: DataFrame,
    to_level2: Mapping[str, str],
    to_level1: Mapping[str, str],
    source: str = "cell_type",
) -> DataFrame:
    """Level 2 from the fine label, level 1 from level 2."""
    return df.withColumn("level_2_cell_type", replace_exact(source, to_level2)).withColumn(
        "level_1_cell_type", replace_exact("level_2_cell_type", to_level1)
    )


# -- rows ------------------------------------------------------------------


def exclude_values(df: DataFrame, name: str, values: Iterable) -> DataFrame:
    """Drop rows whose value is listed; null rows stay."""
    return df.where(~isin_or_null_false(name, values))


def keep_values(df: DataFrame, name: str, values: Iterable | DataFrame) -> DataFrame:
    """Keep rows whose value is listed, or occurs in a one-column table."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(name).distinct(), name, "left_semi").select(*df.columns)
    return df.where(F.col(name).isin(list(values)))


def drop_unknown(df: DataFrame, name: str, unknown: Iterable = ("Unknown",)) -> DataFrame:
    """Rows with a usable class only, before fitting or scoring."""
    return df.where(F.col(name).isNotNull() & ~F.col(name).isin(list(unknown)))


def bin_out_of_vocab(
    df: DataFrame, true_col: str, pred_col: str, extra: Sequence[str] = (), other: str = "Other"
) -> DataFrame:
    """Predictions that never occur as a true label become ``other``."""
    vocab = df.where(F.col(true_col).isNotNull()).groupBy(F.col(true_col).alias(pred_col)).agg(F.lit(True).alias("_seen"))
    vocab = stage(vocab, "vocab")
    known = F.col("_seen").isNotNull() | isin_or_null_false(pred_col, extra)
    out = df.join(vocab, pred_col, "left").withColumn(pred_col, F.when(known, F.col(pred_col)).otherwise(other))
    return out.select(*df.columns)


def drop_rare_classes(df: DataFrame, name: str, min_n: int = 10) -> DataFrame:
    """Rows of classes with at least ``min_n`` rows."""
    kept = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n).select(name)
    return df.join(stage(kept, "classes"), name, "left_semi").select(*df.columns)


def drop_outlier_rows(df: DataFrame, markers: Sequence[str], q: float = 0.999) -> DataFrame:
    """Drop a row when any marker lies strictly above its exact quantile."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("marker"), F.col(m).cast("double").alias("v")) for m in markers
    ])).alias("r")).select("r.marker", "r.v")
    limits = exact_quantiles(long, ["marker"], "v", {"q": q})
    by_marker = limits.select(F.map_from_entries(F.collect_list(F.struct("marker", "q")))).scalar()
    above = F.lit(False)
    for m in markers:
        above |= F.coalesce(F.col(m) > by_marker[m], F.lit(False))
    return df.where(~above)


def dedup_keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate rather than a window: each task keeps one row per key, so a
    key that holds most of the table is no heavier than any other.
    """
    rest = [c for c in df.columns if c not in key]
    sort_key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    first = F.min_by(F.struct(*rest), sort_key).alias("_r")
    return df.groupBy(*key).agg(first).select(*key, "_r.*").select(*df.columns)


def expand_range(df: DataFrame, low: Column, high: Column, out: str, step: int = 100_000) -> DataFrame:
    """Each row once per whole number from ``low`` to ``high``.

    Long ranges are cut into steps that are spread over the tasks before they
    are written out, so one long range is no heavier than many short ones.
    """
    low, high = low.cast("bigint"), high.cast("bigint")
    cut = df.withColumn("_from", F.explode(F.sequence(low, high, F.lit(step).cast("bigint"))))
    spread = cut.repartition("_from", *[c for c in df.columns])
    upto = F.least(F.col("_from") + step - 1, high)
    return spread.withColumn(out, F.explode(F.sequence(F.col("_from"), upto))).drop("_from")


def dense_reindex(
    df: DataFrame, by: Sequence[str], id_col: str, default: Mapping[str, object], start: int = 1, last: int | DataFrame | None = None
) -> DataFrame:
    """One row per id from ``start`` to the largest id of each group.

    ``last`` sets the end of the range instead: a number, or a table of ``by``
    and ``last``, which may also name groups without any row. Ids without a row get the default values and ``_is_dummy`` true.
    """
    if isinstance(last, DataFrame):
        top = last.select(*by, F.col("last").cast("bigint").alias("_top"))
    else:
        end = F.max(id_col) if last is None else F.lit(last)
        top = df.groupBy(*by).agg(end.cast("bigint").alias("_top"))
    top = top.where(F.col("_top") >= start)
    ids = expand_range(top, F.lit(start), F.col("_top"), id_col).drop("_top")
    out = ids.join(df.withColumn("_real", F.lit(True)), [*by, id_col], "left")
    for name, value in default.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out.withColumn("_is_dummy", F.col("_real").isNull()).drop("_real")


def filter_low_confidence(
    df: DataFrame, prob: str, threshold: float, label_col: str | None = None, label: str | None = None
) -> DataFrame:
    """Rows at or below a confidence, a missing one counting as 1."""
    keep = F.coalesce(F.col(prob), F.lit(1.0)) <= threshold
    if label is not None:
        keep &= F.col(label_col) == label
    return df.where(keep)


# -- codes -----------------------------------------------------------------


def label_dictionary(df: DataFrame, name: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Distinct labels in alphabetical order with 0-based codes; excluded ones get -1."""
    labels = df.where(F.col(name).isNotNull()).select(F.col(name).alias("phenotype")).distinct()
    ranked = labels.where(~F.col("phenotype").isin(list(excluded))).withColumn(
        "label", (F.row_number().over(W.orderBy("phenotype")) - 1).cast("int")
    )
    if not excluded:
        return ranked
    return ranked.unionByName(labels.where(F.col("phenotype").isin(list(excluded))).withColumn("label", F.lit(-1)))


def category_codes(df: DataFrame, name: str, out: str = "code", excluded: Sequence[str] = ()) -> DataFrame:
    """Add the code of each label; null and excluded labels get -1."""
    codes = stage(label_dictionary(df, name, excluded), "codes")
    codes = codes.select(F.col("phenotype").alias(name), F.col("label").alias(out))
    return df.join(codes, name, "left").withColumn(out, F.coalesce(out, F.lit(-1))).select(*df.columns, out)


def compact_codes(df: DataFrame, label: str, split: str, train: str = "train", out: str = "code") -> DataFrame:
    """Codes 0..n-1 from the training labels; rows of other splits with unseen labels go.

    Test rows are kept with a null code, as they are only scored.
    """
    codes = stage(label_dictionary(df.where(F.col(split) == train), label), "codes")
    codes = codes.select(F.col("phenotype").alias(label), F.col("label").alias(out))
    kept = df.join(codes, label, "left").where(F.col(out).isNotNull() | (F.col(split) == "test"))
    return kept.select(*df.columns, out)


def restore_labels(df: DataFrame, code: str, codes: DataFrame, out: str = "predicted_phenotype") -> DataFrame:
    """Class names for integer codes, from a ``label``/``phenotype`` dictionary."""
    names = codes.select(F.col("label").alias(code), F.col("phenotype").alias(out))
    return df.join(names, code, "left").select(*df.columns, out)


# -- checks ----------------------------------------------------------------


def missing_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of nulls per column and overall, one row each, in one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    overall = sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("rate")) for c in cols]
    pairs.append(F.struct(F.lit("*").alias("column"), overall.alias("rate")))
    return rates.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def check_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with a plan-time type check and a run-time null check on its features."""
    numeric = set(numeric_columns(df))
    wrong = [c for c in cols if c not in numeric]
    if wrong:
        raise TypeError(f"features are not numeric: {wrong}")
    checked = {
        c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in feature {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c in cols
    }
    return df.withColumns(checked)
