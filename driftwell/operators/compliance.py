"""Whole-text compliance scans: forbidden statements, negated terms, disclaimers, raw-content fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import fixed_values as fv

# Keys of a timing record that would hold raw content.
RAW_CONTENT_FIELDS = ["key", "char", "text", "value", "code"]


def offenders(text: Column, phrases: list[str]) -> Column:
    """Phrases contained in the text, case-insensitive."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(p.lower()), F.lit(p)) for p in phrases]))


def phrase_scan(df: DataFrame, text: str, phrases: list[str] = fv.FORBIDDEN_STATEMENTS) -> DataFrame:
    return df.withColumn("offenders", offenders(F.col(text), phrases)).withColumn("compliant", F.size("offenders") == 0)


def phrase_counts(df: DataFrame, text: str, phrases: list[str] = fv.FORBIDDEN_STATEMENTS) -> DataFrame:
    """Texts per phrase: one pass with a counter per phrase, no exploded rows."""
    low = F.lower(F.col(text))
    wide = df.agg(*[F.count_if(low.contains(p.lower())).alias(str(i)) for i, p in enumerate(phrases)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(str(i)).alias("texts")) for i, p in enumerate(phrases)])))


def negation_scan(df: DataFrame, text: str, term: str, negated: str) -> DataFrame:
    """Lines that use a term outside its negated form.

    ``strict_violations`` counts every such line; ``violations`` clears a text that holds the negated form anywhere.
    """
    low = F.lower(F.col(text))
    bad = F.filter(F.split(low, "\n"), lambda line: line.contains(term) & ~line.contains(negated))
    return df.withColumn("strict_violations", F.size(bad)).withColumn(
        "violations", F.when(low.contains(negated), 0).otherwise(F.col("strict_violations"))
    )


def required_phrase(df: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """Texts that hold none of the required phrases."""
    found = F.size(offenders(F.col(text), phrases)) > 0
    return df.where(~F.coalesce(found, F.lit(False)))


def forbidden_fields(df: DataFrame, payload: str, names: list[str] = RAW_CONTENT_FIELDS) -> DataFrame:
    """Top-level keys of a JSON payload that are not allowed."""
    keys = F.coalesce(F.json_object_keys(F.col(payload)), F.array().cast("array<string>"))
    return df.withColumn("violations", F.array_intersect(keys, F.array(*[F.lit(n) for n in names])))


def field_counts(scanned: DataFrame) -> DataFrame:
    return scanned.select(F.explode("violations").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("records"))
