"""Record curation: field split, first-match rejection, keep-first deduplication, accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_record(raw: Column) -> Column:
    """(smiles, fields): at TABs if the record has one, else once at white space; fields trimmed, blanks dropped."""
    parts = F.when(F.contains(raw, F.lit("\t")), F.split(raw, "\t")).otherwise(F.split(F.trim(raw), "\\s+", 2))
    clean = F.transform(parts, lambda x: F.trim(x))
    return F.struct(F.get(clean, F.lit(0)).alias("smiles"), F.filter(F.slice(clean, 2, F.greatest(F.size(clean), F.lit(1))), lambda x: x != "").alias("fields"))


def provenance(fields: Column) -> Column:
    """Source fields as one text: joined by a semicolon, TABs and line feeds as blanks."""
    return F.regexp_replace(F.array_join(fields, ";"), "[\\t\\n\\r]", " ")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule, in order, that rejects the record; null if none does."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules), F.lit(None).cast("string"))


def error_class(reason: Column) -> Column:
    """error for stage/Type reasons, filtered for rule names, ok without a reason."""
    return F.when(reason.isNull(), "ok").when(F.contains(reason, F.lit("/")), "error").otherwise("filtered")


def keep_first(df: DataFrame, key: Sequence[str], order: str, strict: bool = False) -> DataFrame:
    """The first row of each key; a hash aggregate over structs, so a hot key is reduced before the shuffle.

    A null key is a key like others; if strict it ends the job with an error.
    """
    if strict:
        for k in key:
            df = df.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null key {k}")).cast(df.schema[k].dataType)).otherwise(F.col(k)))
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_kept"))
    return kept.select(*key, *(F.col(f"_kept.{c}").alias(c) for c in rest)).select(*df.columns)


def breakdown(df: DataFrame, by: str, total: str = "n") -> DataFrame:
    """Counts by reason with the share of all, most common first; reasons are few."""
    counted = df.groupBy(by).agg(F.count("*").alias(total))
    return counted.withColumn("share", F.round(F.col(total) / F.sum(total).over(Window.partitionBy()), 6)).orderBy(F.desc(total), by)


def reason_parts(reason: Column) -> Column:
    """(stage, error_type, message) of stage/Type: message; nulls for plain reasons."""
    has = F.contains(reason, F.lit("/"))
    rest = F.regexp_extract(reason, r"(?s)^[^/]*/(.*)$", 1)
    return F.struct(
        F.when(has, F.substring_index(reason, "/", 1)).alias("stage"),
        F.when(has, F.trim(F.regexp_extract(rest, r"(?s)^([^:]*)", 1))).alias("error_type"),
        F.when(has, F.trim(F.regexp_extract(rest, r"(?s)^[^:]*:?(.*)$", 1))).alias("message"),
    )


def summary(df: DataFrame, status: str, key: Sequence[str]) -> DataFrame:
    """One row: total, succeeded, filtered, errored, and duplicates among the succeeded."""
    counts = df.agg(F.count("*").alias("total_input"), *(F.count_if(F.col(status) == s).alias(n) for s, n in (("filtered", "filtered"), ("error", "errored"))))
    ok = df.where(F.col(status) == "ok")
    distinct = ok.groupBy(*key).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("records"), F.count("*").alias("succeeded"))
    both = counts.crossJoin(distinct)  # one row each
    return both.select("total_input", "succeeded", "filtered", "errored", (F.col("records") - F.col("succeeded")).alias("duplicates"))
