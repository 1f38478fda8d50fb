"""SQL fragments shared by the stated results."""

from __future__ import annotations

from driftwell.plans.tables import CALIBRATION_END, EVENT_MODALITY


def rn(e: str, digits: int) -> str:
    s = f"1e{digits}"
    return f"(CASE WHEN abs({e})*{s} >= 9007199254740992e0 THEN CAST({e} AS DOUBLE) ELSE sign({e})*TRY_CAST(floor(abs({e})*{s}+0.5) AS BIGINT)/{s} END)"


def r4(e: str) -> str:
    return rn(e, 4)


def exact(e: str, over: str = "") -> str:
    """Sum of doubles in decimal arithmetic."""
    return f"CAST(sum(CAST(CAST(CAST({e} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,12))){over} AS DOUBLE)"


def mdn(e: str, only: str = "") -> str:
    """Median of a group: half the sum of its middle values."""
    arr = f"list_sort(list(CAST({e} AS DOUBLE)){only})"
    return med(arr)


def med(arr: str) -> str:
    """Median of a sorted list column."""
    return f"(({arr}[CAST(floor((len({arr})-1)/2) AS INT)+1] + {arr}[CAST(floor(len({arr})/2) AS INT)+1])/2)"


def quant(arr: str, q: float) -> str:
    p = f"((len({arr})-1)*CAST({q} AS DOUBLE))"
    lo, hi = f"CAST({arr}[CAST(floor({p}) AS INT)+1] AS DOUBLE)", f"{arr}[CAST(ceil({p}) AS INT)+1]"
    return f"({lo} + ({p}-floor({p}))*({hi}-{lo}))"


_case = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in EVENT_MODALITY.items())
SESSIONS = f"""sessions AS (
  SELECT event_id, user_id AS participant_id, CASE event_type {_case} END AS modality, ts, CAST(ts AS DATE) AS date,
         value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER)/1e2 AS quality_score
  FROM events)"""

HUB = f"""{SESSIONS},
hub AS (
  SELECT participant_id, 'all' AS modality, 'value' AS feature_name, date,
         {r4(mdn("value"))} AS value, {r4(mdn("quality_score"))} AS quality_score,
         count(*) AS n_sessions
  FROM sessions WHERE quality_score >= 0.5 GROUP BY participant_id, date)"""

# Same hub per modality.
HUB_BY_MODALITY = HUB.replace("'all' AS modality", "modality").replace("GROUP BY participant_id, date", "GROUP BY participant_id, modality, date")


def baseline_ctes(hub: str = HUB, where: str = f"date <= DATE '{CALIBRATION_END}'", min_days: int = 14) -> str:
    return f"""{hub},
b0 AS (
  SELECT participant_id, modality, feature_name, list_sort(list(CAST(value AS DOUBLE))) AS arr, {exact("value")} AS total,
         stddev_samp(value) AS sd, min(date) AS baseline_start_date, max(date) AS baseline_end_date
  FROM hub WHERE {where} GROUP BY ALL),
b1 AS (
  SELECT *, len(arr) AS sample_count, {r4("(total/len(arr))")} AS baseline_mean,
         {r4(med("arr"))} AS baseline_median, {r4("coalesce(sd,0e0)")} AS baseline_std,
         {r4(quant("arr", 0.25))} AS q1, {r4(quant("arr", 0.75))} AS q3
  FROM b0),
b2 AS (
  SELECT *, list_sort([abs(v - baseline_median) for v in arr]) AS dev, {r4("(q3-q1)")} AS iqr,
         CASE WHEN baseline_mean <> 0 THEN {r4("(baseline_std/baseline_mean)")} ELSE 0 END AS cv0
  FROM b1),
b3 AS (
  SELECT *, {r4(med("dev"))} AS baseline_mad, abs(cv0) AS coefficient_of_variation FROM b2),
b4 AS (
  SELECT *, CASE WHEN baseline_mad > 0 THEN baseline_mad WHEN baseline_std > 0 THEN baseline_std ELSE 0.001::DOUBLE END AS unit,
         CASE WHEN baseline_mad > 0 THEN baseline_mad WHEN baseline_std > 0 THEN {r4("(baseline_std*0.6745::DOUBLE)")} ELSE 0.001::DOUBLE END AS disp
  FROM b3),
baseline AS (
  SELECT *, {r4("(baseline_median-3*unit)")} AS lower_bound, {r4("(baseline_median+3*unit)")} AS upper_bound,
         CASE WHEN sample_count >= {min_days} THEN 'established' ELSE 'calibrating' END AS baseline_status
  FROM b4)"""


def zscore_ctes(hub: str = HUB) -> str:
    """Adds dev: every hub row with its z-score and method."""
    return f"""{baseline_ctes(hub)},
dev AS (
  SELECT h.*, b.baseline_mean, b.baseline_median, b.baseline_std, b.baseline_mad, b.disp,
         CASE WHEN b.participant_id IS NULL THEN 'missing_baseline' WHEN b.baseline_std > 1e-6 THEN 'parametric_std'
              WHEN b.baseline_mad > 1e-6 THEN 'mad_fallback' WHEN abs(h.value-b.baseline_median) < 1e-6 THEN 'zero_dispersion'
              ELSE 'zero_dispersion_extreme' END AS method,
         CASE WHEN b.participant_id IS NULL THEN NULL
              WHEN b.baseline_std > 1e-6 THEN {r4("((h.value-b.baseline_mean)/b.baseline_std)")}
              WHEN b.baseline_mad > 1e-6 THEN {r4("(0.6745::DOUBLE*(h.value-b.baseline_median)/b.baseline_mad)")}
              WHEN abs(h.value-b.baseline_median) < 1e-6 THEN 0e0
              WHEN h.value >= b.baseline_median THEN 1e1 ELSE -1e1 END AS z_score
  FROM hub h LEFT JOIN baseline b USING (participant_id, modality, feature_name))"""


DEVIATION_LABEL = """CASE WHEN z_score IS NULL OR abs(z_score) < 1.5 THEN 'Within personal baseline'
  WHEN abs(z_score) < 2 THEN 'Mild deviation from baseline' WHEN abs(z_score) < 3 THEN 'Moderate deviation from baseline'
  ELSE 'Significant deviation from baseline' END"""
