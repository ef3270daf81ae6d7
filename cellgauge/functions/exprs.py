"""Small expression builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def replace_exact(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Whole-value replacement, all pairs at once; unmapped values stay."""
    c = col(c)
    return F.coalesce(literal_map(mapping)[c], c) if mapping else c


def replace_text(c: str | Column, old: str, new: str, regex: bool = False) -> Column:
    c = col(c)
    return F.regexp_replace(c, old, new) if regex else F.replace(c, F.lit(old), F.lit(new))


def base_stem(c: str | Column) -> Column:
    """File name without folder and without any of its extensions; a leading dot is kept."""
    name = F.regexp_replace(col(c), r"^.*/", "")
    return F.regexp_replace(name, r"^(.+?)\..*$", "$1")


def relabel_if_contains(c: str | Column, words: Iterable[str], value: str) -> Column:
    """``value`` where the text holds one of ``words`` in any case; null stays null."""
    c = col(c)
    return F.when(c.rlike("(?i)(" + "|".join(words) + ")"), F.lit(value)).otherwise(c)


def yes_no_to_int(c: str | Column) -> Column:
    c = F.lower(F.trim(col(c)))
    return F.when(c == "yes", 1).when(c == "no", 0).cast("int")


def effective_label(new: str | Column, old: str | Column) -> Column:
    """The corrected label when there is one, else the original."""
    new, old = col(new), col(old)
    return F.when(new.isNotNull() & (new != ""), new).otherwise(old)


def composite_key(*cols: str | Column) -> Column:
    return F.concat_ws("_", *[col(c).cast("string") for c in cols])


def isin_or_null_false(c: str | Column, values: Iterable) -> Column:
    """Membership that is false, not null, for a null value."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def order_hash(seed: int, *key: str | Column) -> Column:
    """A reproducible pseudo-random order key any engine can compute."""
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in key]
    return F.md5(F.concat_ws("-", *parts))


def hash_uniform(seed: int, *key: str | Column) -> Column:
    """A number in [0, 1) drawn from the first 12 hex digits of the order key."""
    digits = F.conv(F.substring(order_hash(seed, *key), 1, 12), 16, 10).cast("double")
    return digits / F.lit(float(16**12))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate, over rows that have both values; null without variance."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


# -- vectors ---------------------------------------------------------------


def parse_vector(text: str | Column) -> Column:
    """A string-encoded list of numbers as ``array<double>``."""
    return F.from_json(col(text), "array<double>")


def argmax(vec: str | Column) -> Column:
    """0-based position of the first maximum."""
    vec = col(vec)
    return F.array_position(vec, F.array_max(vec)).cast("int") - 1


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
