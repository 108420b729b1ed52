"""DataFrame-level cleaning and idempotent loading of raw lead rows.

``clean_leads`` is a chain of ``select`` steps that Catalyst collapses into a
single projection; no step touches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.constants import (CSV_COLUMN_MAP, LABEL_CSV_COLUMN, NUMERIC_CSV_COLUMNS, SOURCE_SYSTEM,
                                  YES_NO_CSV_COLUMNS)
from propensity.functions import cleaning as fc
from propensity.operators.windows import dedup_first


def _string_cols(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}


def _apply(df: DataFrame, rules: dict) -> DataFrame:
    """One projection: ``rules`` maps a column to its SQL rule, the rest pass through."""
    out = []
    for c in df.columns:
        q = fc.quote(c)
        out.append(f"{rules[c](q)} AS {q}" if c in rules else q)
    return df.selectExpr(*out)


def na_tokens_to_null(df: DataFrame, exclude=()) -> DataFrame:
    """CSV missing-value tokens -> NULL on every string column (reader semantics)."""
    return _apply(df, {c: fc.na_token_sql for c in _string_cols(df) if c not in exclude})


def strip_strings(df: DataFrame) -> DataFrame:
    return _apply(df, {c: fc.strip_sql for c in _string_cols(df)})


def replace_placeholders(df: DataFrame) -> DataFrame:
    """Strip every string column; ``select`` (any case) and '' become NULL.

    Two projections, so each value is trimmed once and the rule reads the result."""
    strs = _string_cols(df)
    return _apply(strip_strings(df), {c: fc.stripped_placeholder_sql for c in strs})


def convert_booleans(df: DataFrame) -> DataFrame:
    """Yes/No columns -> non-null boolean; the label -> nullable boolean."""
    rules = {c: fc.yes_no_sql for c in YES_NO_CSV_COLUMNS if c in df.columns}
    if LABEL_CSV_COLUMN in df.columns:
        rules[LABEL_CSV_COLUMN] = fc.flag_sql
    return _apply(df, rules)


def coerce_numerics(df: DataFrame) -> DataFrame:
    return _apply(df, {c: fc.number_sql for c in NUMERIC_CSV_COLUMNS if c in df.columns})


def rename_columns(df: DataFrame, keep=()) -> DataFrame:
    """Mapped CSV columns renamed, in map order; unmapped ones dropped, missing ones
    tolerated.  ``keep`` columns pass through unchanged (e.g. an input-order column)."""
    cols = set(df.columns)
    present = [(src, dst) for src, dst in CSV_COLUMN_MAP if src in cols]
    return df.selectExpr(*[f"{fc.quote(src)} AS {dst}" for src, dst in present], *[fc.quote(k) for k in keep])


def clean_leads(df: DataFrame, keep=("input_order",)) -> DataFrame:
    """placeholders -> booleans -> numerics -> rename (the first three on CSV names)."""
    keep = [k for k in keep if k in df.columns]
    return (df.transform(replace_placeholders).transform(convert_booleans)
            .transform(coerce_numerics).transform(lambda d: rename_columns(d, keep)))


def split_required(df: DataFrame, key: str = "external_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid rows have a non-blank key; the two are complements."""
    ok = fc.non_blank(key)
    return df.where(ok), df.where(~ok)


def add_source_system(df: DataFrame, value: str = SOURCE_SYSTEM) -> DataFrame:
    return df.withColumn("source_system", F.lit(value))


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return _apply(df, {c: fc.nan_sql for c in doubles})


def prepare_load(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw CSV rows -> (valid rows ready to insert, rejected rows)."""
    cleaned = clean_leads(na_tokens_to_null(raw, exclude=("input_order",)))
    valid, rejected = split_required(cleaned)
    return nan_to_null(add_source_system(valid)), rejected


def rows_to_insert(existing: DataFrame | None, valid: DataFrame, key: str = "external_id",
                   order: str = "input_order") -> DataFrame:
    """Insert-or-ignore on ``key``: the first row per key in input order wins, and
    keys already present in ``existing`` are skipped."""
    first = dedup_first(valid, key, [order])
    if existing is None:
        return first
    return first.join(existing.select(key), key, "left_anti")


def load_summary(raw: DataFrame, existing: DataFrame | None = None, key: str = "external_id", label: str = "converted") -> DataFrame:
    """What loading ``raw`` into ``existing`` does, in one row: total_read, total_rejected,
    total_skipped, total_inserted, conversion_rate (% of valid rows, 1 decimal, half-even; 0
    when empty).

    One scan: rows are counted per key, a rejected row under none, and the counts summed.  A
    key that the table has not is inserted once, its other rows are skipped."""
    cleaned = clean_leads(na_tokens_to_null(raw, exclude=("input_order",)))
    keyed = cleaned.select(F.when(fc.non_blank(key), F.col(key)).alias("_k"), F.col(label).alias("_y"))
    per = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_y").alias("_c"))
    there = F.lit(False)
    if existing is not None:
        per = per.join(existing.select(F.col(key).alias("_k"), F.lit(True).alias("_there")), "_k", "left")
        there = F.coalesce("_there", F.lit(False))
    valid = F.col("_k").isNotNull()
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("bigint")
    agg = per.agg(total("_n", F.lit(True)).alias("total_read"), total("_n", ~valid).alias("total_rejected"),
                  total("_n", valid).alias("_valid"), total("_c", valid).alias("_conv"),
                  F.count_if(valid & ~there).alias("total_inserted"))
    rate = F.when(F.col("_valid") > 0, F.bround(F.col("_conv") / F.col("_valid") * F.lit(100.0), 1)) \
        .otherwise(F.lit(0.0))
    return agg.select("total_read", "total_rejected",
                      (F.col("_valid") - F.col("total_inserted")).alias("total_skipped"),
                      "total_inserted", rate.alias("conversion_rate"))


def null_percentages(df: DataFrame, exclude=("source_system",)) -> DataFrame:
    """Long form (column_name, null_pct): % NULL per column, 1 decimal, half-even,
    0 when the frame is empty; one pass over the data."""
    cols = [c for c in df.columns if c not in exclude]
    n = F.count(F.lit(1))
    aggs = [F.when(n > 0, F.bround(F.count_if(F.col(f"`{c}`").isNull()) / n * F.lit(100.0), 1))
            .otherwise(F.lit(0.0)).alias(c) for c in cols]
    wide = df.agg(*aggs)
    return wide.unpivot([], cols, "column_name", "null_pct")
