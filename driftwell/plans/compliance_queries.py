"""J: text scans over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import compliance as cp
from driftwell.plans import tables as tb
from driftwell.plans.quality_queries import _errs
from driftwell.plans.registry import query

# Words that occur in the given prose stand for the forbidden statements.
PHRASES = ["the and", "email", "license", "of that"]
TERM, NEGATED = "thion", "the thion"


@query("J1_phrase_scan", "SELECT doc_id, " + _errs(*[(f"contains(lower(text), '{p}')", p) for p in PHRASES]) + " AS offenders, NOT (" + " OR ".join(f"contains(lower(text), '{p}')" for p in PHRASES) + ") AS compliant FROM documents")
def phrase_scan(spark, sf):
    return cp.phrase_scan(tb.table(spark, sf, "documents"), "text", PHRASES).select("doc_id", "offenders", "compliant")


@query("J1_phrase_counts", " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER (contains(lower(text), '{p}')) AS texts FROM documents" for p in PHRASES))
def phrase_counts(spark, sf):
    return cp.phrase_counts(tb.table(spark, sf, "documents"), "text", PHRASES)


@query(
    "J2_negation_scan",
    f"""WITH c AS (SELECT conv_id, turn, lower(text) AS t, [x for x in string_split(lower(text), chr(10)) if contains(x, '{TERM}') AND NOT contains(x, '{NEGATED}')] AS bad FROM conversations)
SELECT conv_id, turn, len(bad) AS strict_violations, CASE WHEN contains(t, '{NEGATED}') THEN 0 ELSE len(bad) END AS violations FROM c""",
)
def negation_scan(spark, sf):
    c = cp.negation_scan(tb.table(spark, sf, "conversations"), "text", TERM, NEGATED)
    return c.select("conv_id", "turn", "strict_violations", "violations")


@query("J3_required_phrase", "SELECT doc_id, source FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), 'that of'))")
def required_phrase(spark, sf):
    return cp.required_phrase(tb.table(spark, sf, "documents"), "text", ["License", "that of"]).select("doc_id", "source")


@query("J4_forbidden_fields", "SELECT event_id, CASE WHEN value > 100 THEN 'k|text' WHEN value > 50 THEN 'k' ELSE '' END AS violations FROM events")
def forbidden_fields(spark, sf):
    return cp.forbidden_fields(_payloads(spark, sf), "payload", ["k", "text"]).select("event_id", "violations")


def _payloads(spark, sf):
    ev = tb.table(spark, sf, "events")
    kept, renamed = F.col("props"), F.regexp_replace("props", '"k"', '"q"')
    with_text = F.regexp_replace("props", r"\}$", ', "text": "x"}')
    return ev.select("event_id", F.when(F.col("value") > 100, with_text).when(F.col("value") > 50, kept).otherwise(renamed).alias("payload"))


@query("J4_field_counts", "SELECT 'k' AS field, count(*) AS records FROM events WHERE value > 50 UNION ALL SELECT 'text', count(*) FROM events WHERE value > 100")
def field_counts(spark, sf):
    return cp.field_counts(cp.forbidden_fields(_payloads(spark, sf), "payload", ["k", "text"]))
