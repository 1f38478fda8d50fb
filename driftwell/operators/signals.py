"""Features of raw recordings: keystrokes, taps, acceleration, force, eyelid, gaze, voice frames.

Input is one row per sample. Everything sequential goes through ``sequenced``, so no recording has to fit one task;
features are partial aggregates over its output.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.numeric import clamp, reasons, round4, round_half_away
from driftwell.operators.ordered import sequenced
from driftwell.operators.spectrum import power_bins
from driftwell.session import cut_lineage

# Helpers of Python stages travel by value: workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = "session_id"
CHUNK = 60_000.0


def half_up(x: Column, digits: int) -> Column:
    s = F.lit(float(10**digits))
    return F.floor(x * s + 0.5) / s


def _pop_cv(n: Column, s: Column, ss: Column) -> Column:
    """Population standard deviation over mean from count, sum and sum of squares; 0 for a zero mean."""
    mean = s / n
    var = F.greatest((n * ss - s * s) / (n * n), F.lit(0.0))
    return F.when(mean != 0, F.sqrt(var) / mean).otherwise(F.lit(0.0))


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ---- typing ----------------------------------------------------------------------------------------------------

def key_intervals(events: DataFrame, key: str = KEY, chunk: float = CHUNK) -> DataFrame:
    """Press and release rows (``kind`` down / up, ``press_id``) to one row per key: hold time and interval."""
    presses = events.groupBy(key, "press_id").agg(
        F.max(F.when(F.col("kind") == "down", F.col("t_ms"))).alias("press_ms"),
        F.max(F.when(F.col("kind") == "up", F.col("t_ms"))).alias("release_ms"),
    )
    done = presses.where(F.col("press_ms").isNotNull() & F.col("release_ms").isNotNull())
    seq = sequenced(done, [key], "press_ms", chunk, ["press_ms"], tie="press_id")
    return seq.select(
        key,
        "press_id",
        "idx",
        half_up(F.greatest(_d("release_ms") - _d("press_ms"), F.lit(0.0)), 2).alias("hold_ms"),
        half_up(F.coalesce(_d("press_ms") - _d("prev_press_ms"), F.lit(0.0)), 2).alias("iki_ms"),
    )


def typing_features(keys: DataFrame, key: str = KEY, chunk: float = CHUNK, tie: str | None = None) -> DataFrame:
    """Speed, interval mean and sample deviation (about the rounded mean), pauses and corrections per minute, rhythm."""
    seq = sequenced(keys, [key], "t_ms", chunk, ["t_ms"], tie=tie)
    iki = _d("t_ms") - _d("prev_t_ms")
    g = seq.groupBy(key).agg(
        F.count(F.lit(1)).alias("keystroke_count"),
        (F.max("t_ms") - F.min("t_ms")).alias("span"),
        F.count(iki).alias("n"),
        F.sum(iki).alias("s"),
        F.sum(iki * iki).alias("ss"),
        F.count_if(iki > 500).alias("pause_count"),
        F.count_if("is_correction").alias("correction_count"),
    )
    seconds = _d("span") / 1000.0
    mean = F.when(F.col("n") > 0, half_up(F.col("s") / F.col("n"), 2)).otherwise(F.lit(0.0))
    m = F.col("mean_inter_key_interval")
    var = (F.col("ss") - 2.0 * m * F.col("s") + F.col("n") * m * m) / (F.col("n") - 1)
    minutes = F.col("session_duration") / 60.0

    def per(c: Column, unit: Column, digits: int) -> Column:
        return F.when(unit > 0, half_up(c / unit, digits)).otherwise(F.lit(0.0))

    return (
        g.withColumns({"session_duration": seconds, "mean_inter_key_interval": mean})
        .withColumn(
            "std_inter_key_interval", F.when(F.col("n") > 1, half_up(F.sqrt(F.greatest(var, F.lit(0.0))), 2)).otherwise(F.lit(0.0))
        )
        .select(
            key,
            "keystroke_count",
            per(F.col("keystroke_count"), F.col("session_duration"), 3).alias("typing_speed"),
            "mean_inter_key_interval",
            "std_inter_key_interval",
            per(F.col("pause_count"), minutes, 2).alias("pause_rate"),
            per(F.col("correction_count"), minutes, 2).alias("correction_rate"),
            F.when(m > 0, half_up(F.col("std_inter_key_interval") / m, 4)).otherwise(F.lit(0.0)).alias("rhythm_variability"),
        )
    )


# ---- tapping ---------------------------------------------------------------------------------------------------

def tapping_features(taps: DataFrame, key: str = KEY, chunk: float = CHUNK, tie: str | None = None) -> DataFrame:
    """Rate, mean interval, variation and decline slope of the 50-2000 ms intervals; too few give nulls and a status."""
    seq = sequenced(taps, [key], "t_ms", chunk, ["t_ms"], tie=tie).withColumn("iti", _d("t_ms") - _d("prev_t_ms"))
    totals = seq.groupBy(key).agg(F.count(F.lit(1)).alias("taps"), ((F.max("t_ms") - F.min("t_ms")) / 1000.0).alias("seconds"))
    # Positions are counted among the valid intervals only.
    valid = seq.where(F.col("iti").between(50, 2000)).select(key, "t_ms", "iti", *([tie] if tie else []))
    pos = sequenced(valid, [key], "t_ms", chunk, tie=tie)
    x, y = _d("idx"), F.col("iti")
    sums = pos.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy")
    )
    n, sx, sy = _d("n"), F.col("sx"), F.col("sy")
    den = n * F.col("sxx") - sx * sx
    status = (
        F.when(F.col("taps") < 3, "insufficient_taps")
        .when(F.coalesce(F.col("n"), F.lit(0)) < 2, "insufficient_valid_intervals")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return totals.join(sums, key, "left").withColumn("status", status).select(
        key,
        F.when(ok, F.col("taps")).otherwise(0).alias("tap_count"),
        F.when(ok, F.when(F.col("seconds") > 0, half_up(F.col("taps") / F.col("seconds"), 3)).otherwise(F.lit(0.0))).alias("tapping_rate"),
        F.when(ok, half_up(sy / n, 2)).alias("interval_mean"),
        F.when(ok, half_up(_pop_cv(n, sy, F.col("syy")), 4)).alias("interval_variability"),
        F.when(ok, F.when(den != 0, half_up((n * F.col("sxy") - sx * sy) / den, 4)).otherwise(F.lit(0.0))).alias("decline_slope"),
        "status",
    )


# ---- walking ---------------------------------------------------------------------------------------------------

def with_magnitude(acc: DataFrame) -> DataFrame:
    return acc.withColumn("mag", F.sqrt(sum((_d(c) * _d(c) for c in ("ay", "az")), _d("ax") * _d("ax"))))


def signal_moments(samples: DataFrame, key: str, value: str) -> DataFrame:
    return samples.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n_samples"), (F.max("t_ms") - F.min("t_ms")).alias("span")
    )


def _hops(t: np.ndarray, start: np.ndarray, own: np.ndarray, min_gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct times of a chunk, which of them are starts, the position each one leads to, and how many are the chunk's own."""
    at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    times = t[at]
    return times, np.logical_or.reduceat(start, at), np.searchsorted(times, times + min_gap), int(own[at].sum())


def refractory(candidates: DataFrame, key: str, min_gap: float, chunk: float, tie: str | None = None) -> DataFrame:
    """Greedy selection in time order: a candidate counts if it is at least ``min_gap`` after the last one that counted.

    A candidate that follows the previous one by ``min_gap`` or more always counts; every other one counts if a counting
    candidate leads to it, that is, if it is the first at least ``min_gap`` later. Chunks of time follow these links in
    parallel. A chunk without such a start only knows where each possible entry leaves it; these border links are
    followed by pointer doubling, so one run of any length takes as many rounds as the logarithm of its chunks. No candidates
    give no rows; equal times count once; rows without key or time are left out.
    """
    kind = candidates.schema[key].dataType.simpleString()
    ahead = 3 * min_gap  # a candidate outside its chunk leads at most two gaps into the next, unless that one is a start
    width = max(chunk, ahead)
    seq = sequenced(candidates, [key], "t_ms", chunk, ["t_ms"], tie=tie)
    t = _d("t_ms")
    home = F.floor(t / width)
    near = F.when(t < home * width + ahead, F.array(home - 1, home)).otherwise(F.array(home))
    placed = seq.select(key, t.alias("t"), F.coalesce(t >= _d("prev_t_ms") + min_gap, F.lit(True)).alias("start"), home.alias("home"), F.explode(near).alias("chunk"))
    lists = placed.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct("t", "start", (F.col("home") == F.col("chunk")).alias("own")))).alias("a"))
    chunks = cut_lineage(lists.select(key, "chunk", F.col("a.t").alias("t"), F.col("a.start").alias("start"), F.col("a.own").alias("own")).where("own[0]"))

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, c, t, start, own in pdf[[key, "chunk", "t", "start", "own"]].itertuples(index=False, name=None):
                times, starts, leads, n = _hops(t, start, own, min_gap)
                known = np.flatnonzero(starts[:n])
                entries = known[-1:] if len(known) else np.flatnonzero(times[:n] <= c * width + ahead)
                ends = entries.copy()
                while (inside := ends < n).any():
                    ends[inside] = leads[ends[inside]]
                for a, b in zip(entries, ends, strict=True):
                    if b < len(times) and not starts[b]:
                        out.append((k, c, None if len(known) else times[a], c + 1, times[b]))
            yield pd.DataFrame(out, columns=[key, "chunk", "t", "to_chunk", "to_t"]).astype({"t": "float64", "to_t": "float64"})

    links = cut_lineage(chunks.mapInPandas(borders, f"`{key}` {kind}, chunk long, t double, to_chunk long, to_t double"))
    links = links.withColumn("t", F.when(~F.isnan("t"), F.col("t")))
    target = [key, F.col("to_chunk").alias("chunk"), F.col("to_t").alias("t")]
    reached, jump = links.where("t IS NULL").select(*target), links.where("t IS NOT NULL")
    while not reached.isEmpty() and not jump.isEmpty():
        reached = cut_lineage(reached.unionByName(reached.join(jump, [key, "chunk", "t"]).select(*target)))
        onward = jump.select(key, F.col("chunk").alias("to_chunk"), F.col("t").alias("to_t"), F.col("to_chunk").alias("end_chunk"), F.col("to_t").alias("end_t"))
        jump = cut_lineage(
            jump.join(onward, [key, "to_chunk", "to_t"]).select(key, "chunk", "t", F.col("end_chunk").alias("to_chunk"), F.col("end_t").alias("to_t"))
        )

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, kept = [], []
            for k, t, start, own, entry in pdf[[key, "t", "start", "own", "entry"]].itertuples(index=False, name=None):
                times, starts, leads, n = _hops(t, start, own, min_gap)
                begins = np.flatnonzero(starts[:n])
                if entry == entry:
                    begins = np.union1d(begins, np.searchsorted(times, [entry]))
                for i, end in pairwise([*begins, n]):
                    while i < end:
                        kept.append(times[i])
                        ids.append(k)
                        i = leads[i]
            yield pd.DataFrame({key: pd.Series(ids, dtype=pdf[key].dtype), "t_ms": pd.Series(kept, dtype="float64")})

    entered = chunks.join(reached.select(key, "chunk", F.col("t").alias("entry")), [key, "chunk"], "left")
    return entered.withColumn("entry", F.coalesce("entry", F.lit(math.nan))).mapInPandas(pick, f"`{key}` {kind}, t_ms double")


MIN_STEP_MS, MAX_STEP_MS = 250.0, 2000.0


def walking_peaks(acc: DataFrame, key: str = KEY, chunk: float = CHUNK, tie: str | None = None, prominence: float = 0.3) -> DataFrame:
    """Accepted step peaks: local maxima above ``prominence`` deviations with a 250 ms refractory time."""
    sig = with_magnitude(acc)
    stats = signal_moments(sig, key, "mag")
    seq = sequenced(sig, [key], "t_ms", chunk, ["mag"], tie=tie, carried=stats)
    v = F.col("mag")
    peak = (v > F.col("prev_mag")) & (v > F.col("next_mag")) & (v - F.col("mean") > prominence * F.col("sd")) & (F.col("n_samples") >= 20)
    candidates = cut_lineage(seq.where(peak).select(key, "t_ms", *([tie] if tie else [])))
    return refractory(candidates, key, MIN_STEP_MS, chunk, tie)


def walking_features(acc: DataFrame, key: str = KEY, chunk: float = CHUNK, tie: str | None = None) -> DataFrame:
    """Cadence, stride mean and variation, movement regularity and step symmetry per recording."""
    sig = with_magnitude(acc)
    stats = signal_moments(sig, key, "mag")
    peaks = cut_lineage(walking_peaks(acc, key, chunk, tie))
    counts = peaks.groupBy(key).agg(F.count(F.lit(1)).alias("peaks"))
    steps = sequenced(peaks, [key], "t_ms", chunk, ["t_ms"]).withColumn("step", _d("t_ms") - _d("prev_t_ms"))
    valid = sequenced(steps.where(F.col("step").between(MIN_STEP_MS, MAX_STEP_MS)).select(key, "t_ms", "step"), [key], "t_ms", chunk)
    pairs = valid.groupBy(key, F.floor(F.col("idx") / 2).alias("pair")).agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("step").alias("total"),
        F.max(F.when(F.col("idx") % 2 == 0, F.col("step"))).alias("even"),
        F.max(F.when(F.col("idx") % 2 == 1, F.col("step"))).alias("odd"),
    )
    # Whole milliseconds are summed, so the result does not depend on the order of rows.
    stride = F.when(F.col("c") == 2, F.col("total"))
    agg = pairs.groupBy(key).agg(
        F.sum("c").alias("n_steps"),
        F.count(stride).cast("double").alias("ns"),
        F.sum(stride).alias("s"),
        F.sum(stride * stride).alias("ss"),
        F.avg("even").alias("even_mean"),
        F.avg("odd").alias("odd_mean"),
    )
    g = stats.join(counts, key, "left").join(agg, key, "left")
    status = (
        F.when(F.col("n_samples") < 20, "insufficient_samples")
        .when(F.coalesce(F.col("peaks"), F.lit(0)) < 2, "insufficient_peaks")
        .when(F.coalesce(F.col("n_steps"), F.lit(0)) < 2, "insufficient_valid_steps")
        .otherwise("ok")
    )
    g = g.withColumn("status", status).withColumn("stride_mean", F.col("s") / F.col("ns") / 1000.0)
    lag = F.floor(F.col("s") / F.col("ns") / (F.col("span") / F.col("n_samples")) + 0.5)
    g = g.withColumn("lag", F.when(F.col("status") == "ok", lag))
    lags = g.where("lag > 0").select(key, "lag")
    acf = autocorr_at(sig.select(key, "t_ms", F.col("mag").alias("value"), *([tie] if tie else [])), lags, key, chunk, tie)
    ok = F.col("status") == "ok"
    even, odd = F.col("even_mean"), F.col("odd_mean")
    return g.join(acf.select(key, "autocorr"), key, "left").select(
        key,
        F.when(ok, half_up(F.col("peaks") / (F.col("span") / 1000.0) * 60, 2)).alias("cadence"),
        F.when(ok, half_up(F.col("stride_mean"), 4)).alias("stride_interval_mean"),
        F.when(ok, F.when(F.col("ns") > 1, half_up(_pop_cv(F.col("ns"), F.col("s"), F.col("ss")), 4)).otherwise(F.lit(0.0))).alias("stride_interval_variability"),
        F.when(ok, half_up(clamp(F.coalesce(F.col("autocorr"), F.lit(0.0)), 0, 1), 4)).otherwise(F.lit(0.0)).alias("movement_regularity"),
        F.when(ok, half_up(1 - F.abs(even - odd) / ((even + odd) / 2), 4)).alias("symmetry_index"),
        F.when(ok, F.col("peaks")).otherwise(0).alias("step_count"),
        "status",
    )


def autocorr_at(samples: DataFrame, lags: DataFrame, key: str = KEY, chunk: float = CHUNK, tie: str | None = None) -> DataFrame:
    """Autocorrelation of ``value`` at one lag per recording (``lags``: key, lag), mapped from [-1, 1] to [0, 1].

    Samples meet their partner by an equi-join on (recording, position + lag): hash-spread, not one recording per task.
    """
    stats = samples.groupBy(key).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n_samples"))
    seq = sequenced(samples.select(key, "t_ms", "value", *([tie] if tie else [])), [key], "t_ms", chunk, tie=tie, carried=stats.join(lags, key))
    base = seq.withColumn("dev", F.col("value") - F.col("mean"))
    partner = base.select(key, (F.col("idx") - F.col("lag")).alias("idx"), F.col("dev").alias("dev_b"))
    acf = base.join(partner, [key, "idx"]).groupBy(key, "lag", "n_samples").agg(
        F.sum(F.col("dev") * F.col("dev_b")).alias("num"), F.sum(F.col("dev") * F.col("dev")).alias("den")
    )
    raw = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0))
    known = acf.select(key, ((raw + 1) / 2).alias("autocorr"))
    return stats.join(lags, key).select(key, "lag").join(known, key, "left").fillna(0.0, ["autocorr"])


# ---- force plate -----------------------------------------------------------------------------------------------

def step_regularity(force: DataFrame, key: str, value: str, rate_hz: float = 100.0, block: int = 1024, min_samples: int = 50) -> DataFrame:
    """Largest normalised autocorrelation over lags of 0.2-2.5 s, clipped to [0, 1]; needs ``idx``.

    Samples are grouped into blocks of fixed length plus the following lag range, so each task sums its own block's
    products for all lags from one bounded array; with a block longer than the lag range a row is repeated at most once
    instead of once per lag.
    """
    lo, hi = int(0.2 * rate_hz), int(2.5 * rate_hz)
    stats = force.groupBy(key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    dev = force.select(key, "idx", F.col(value).alias("v")).join(stats, key).withColumn("d", F.col("v") - F.col("mean"))
    # A sample serves its own block and every earlier block from which a lag can reach it.
    homes = F.sequence(F.greatest(F.lit(0), F.floor((F.col("idx") - (hi - 1)) / block)), F.floor(F.col("idx") / block))
    placed = dev.select(key, "n", "idx", "d", F.explode(homes).alias("b"))
    arrays = placed.groupBy(key, "n", "b").agg(F.sort_array(F.collect_list(F.struct("idx", "d"))).alias("a")).select(
        key, "n", F.transform("a", lambda e: e["d"]).alias("a"), F.least(F.lit(block), F.size("a")).alias("m")
    )
    lags = F.concat(F.array(F.lit(0)), F.sequence(F.lit(lo), F.lit(hi - 1)))

    def product(lag: Column) -> Column:
        pairs = F.least(F.col("m"), F.size("a") - lag)
        return F.when(pairs > 0, F.aggregate(
            F.zip_with(F.slice("a", F.lit(1), pairs), F.slice("a", lag + 1, pairs), lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p
        )).otherwise(F.lit(0.0))

    sums = arrays.select(key, "n", F.explode(F.transform(lags, lambda g: F.struct(g.alias("lag"), product(g).alias("p")))).alias("e"))
    per_lag = sums.groupBy(key, "n", "e.lag").agg(F.sum("e.p").alias("p"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("p")))
    best = F.max(F.when((F.col("lag") >= lo) & (F.col("lag") < F.least(F.lit(hi), F.col("n") - 1)), F.col("p")))
    g = per_lag.groupBy(key, "n").agg(zero.alias("zero"), best.alias("best"))
    return g.select(key, F.when(F.col("n") >= min_samples, round4(clamp(F.col("best") / (F.col("zero") + 1e-12), 0, 1))).alias("step_regularity"))


def stance_swing(force: DataFrame, key: str, value: str, rate_hz: float = 100.0, chunk: float = CHUNK, threshold: float = 0.10) -> DataFrame:
    """One row per completed stance: its length and that of the following swing (samples and seconds), by crossing 10 % of the peak force.

    Only the crossings - about two per step - are ordered a second time. Needs ``idx``. Durations outside 0.2-2 s are
    dropped; a swing counts only after a valid stance.
    """
    lo, hi = int(0.2 * rate_hz), int(2.0 * rate_hz)
    peak = force.groupBy(key).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))
    loads = force.select(key, F.col("idx").alias("pos"), F.col(value).alias("v"))
    seq = sequenced(loads, [key], "pos", chunk, ["v"], carried=peak.where((F.col("peak") > 0) & (F.col("n") >= 10)))
    on, before = ((F.col(c) > threshold * F.col("peak")).cast("int") for c in ("v", "prev_v"))
    change = on - F.coalesce(before, F.lit(0))
    crossings = seq.withColumn("change", change).where("change <> 0").select(key, "pos", "change")
    near = sequenced(crossings, [key], "pos", chunk, ["pos"])
    stance, swing = F.col("pos") - F.col("prev_pos"), F.col("next_pos") - F.col("pos")
    return near.where((F.col("change") == -1) & stance.between(lo, hi)).select(
        key, stance.alias("stance_n"), F.when(swing.between(lo, hi), swing).alias("swing_n")
    ).withColumns({"stance_s": F.col("stance_n") / rate_hz, "swing_s": F.col("swing_n") / rate_hz})


def gait_features(force: DataFrame, key: str, rate_hz: float = 100.0, chunk: float = CHUNK, stride_m: float = 0.72, tie: str | None = None) -> DataFrame:
    """Gait features per trial from both feet; a step interval is a stance with its own swing (unpaired ones drop out)."""
    f = force.withColumns({"left": F.coalesce(_d("total_left"), F.lit(0.0)), "right": F.coalesce(_d("total_right"), F.lit(0.0))})
    slim = f.select(key, "time", "left", "right", (F.col("left") + F.col("right")).alias("total"), *([tie] if tie else []))
    # Read by both feet, the trial totals and the autocorrelation, so it is ordered once and written.
    f = cut_lineage(sequenced(slim, [key], "time", chunk, tie=tie))
    per_foot = stance_swing(f, key, "left", rate_hz, chunk).unionByName(stance_swing(f, key, "right", rate_hz, chunk))
    # Lengths are averaged in whole samples: exact, whatever the order of rows.
    step = F.col("stance_n") + F.col("swing_n")
    steps = per_foot.groupBy(key).agg(
        F.count("stance_n").alias("stances"),
        F.avg("stance_n").alias("stance"),
        F.avg("swing_n").alias("swing"),
        F.count(step).alias("steps"),
        (F.avg(step) * (2.0 / rate_hz)).alias("stride"),
        (F.stddev_pop(step) * (2.0 / rate_hz)).alias("stride_sd"),
    )
    trial = f.groupBy(key).agg(
        (F.max("time") - F.min("time")).cast("double").alias("duration"),
        F.max("total").alias("peak"),
        F.var_pop("total").alias("var"),
        F.avg("left").alias("l"),
        F.avg("right").alias("r"),
    )
    g = trial.join(steps, key, "left").join(step_regularity(f, key, "total", rate_hz), key, "left")
    enough = F.col("stances") >= 2
    paired = enough & (F.col("steps") >= 2)
    stride = round4(F.col("stride"))
    centre = (F.col("l") + F.col("r")) / 2
    return g.select(
        key,
        round_half_away(F.col("duration"), 2).alias("trial_duration_s"),
        F.when(enough & (F.col("swing") > 0), round4(F.col("stance") / F.col("swing"))).alias("stance_swing_ratio"),
        F.when(paired, stride).alias("stride_interval_mean_s"),
        F.when(paired, round4(F.col("stride_sd") / (F.col("stride") + 1e-12) * 100)).alias("stride_interval_cv_pct"),
        F.when(paired, round_half_away(F.col("steps") / F.col("duration") * 60.0, 2)).alias("cadence_steps_per_min"),
        F.when(paired, round4(F.lit(stride_m) * (1.0 / (stride + 1e-12)))).alias("gait_speed_m_per_s"),
        F.when(enough, F.col("step_regularity")).alias("step_regularity"),
        F.when(enough & (F.col("peak") > 0), round4(F.col("var") / (F.col("peak") * F.col("peak") + 1e-12))).alias("accel_variance"),
        F.when(enough & (centre > 0), round4(F.abs(F.col("l") - F.col("r")) / centre * 100.0)).alias("symmetry_index_pct"),
    )


GAIT = ["stride_interval_mean_s", "stride_interval_cv_pct", "cadence_steps_per_min", "gait_speed_m_per_s", "step_regularity", "accel_variance", "stance_swing_ratio", "symmetry_index_pct"]


def motor_features(df: DataFrame, raw: bool, key: str = "participant_id", **options) -> DataFrame:
    """Raw force samples go through ``gait_features`` per participant; a table that already has features is passed on,
    absent ones as null."""
    if raw:
        return gait_features(df, key, **options).select(key, *GAIT)
    return df.select(key, *[(_d(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in GAIT])


# ---- eyes ------------------------------------------------------------------------------------------------------

def blink_features(ear: DataFrame, key: str = KEY, chunk: float = CHUNK, tie: str | None = None, closed_below: float = 0.21) -> DataFrame:
    """Blinks are closed runs of 50-600 ms ending at the first open sample; a run open at the end closes there."""
    flags = ear.withColumn("closed", (_d("ear") < closed_below).cast("int"))
    extra = [tie] if tie else []
    seq = sequenced(flags.select(key, "t_ms", "closed", *extra), [key], "t_ms", chunk, ["closed"], tie=tie)
    span = ear.groupBy(key).agg(F.max("t_ms").alias("last_t"), (F.max("t_ms") - F.min("t_ms")).alias("span"), F.count(F.lit(1)).alias("n"))
    border = seq.where((F.col("closed") != F.col("prev_closed")) | (F.col("prev_closed").isNull() & (F.col("closed") == 1)))
    ends = sequenced(border.select(key, "t_ms", "closed", *extra), [key], "t_ms", chunk, ["t_ms"], tie=tie, carried=span).where("closed = 1")
    blinks = ends.withColumn("dur", _d(F.coalesce("next_t_ms", "last_t")) - _d("t_ms")).where(F.col("dur").between(50, 600))
    seq2 = sequenced(blinks.select(key, "t_ms", "dur", *extra), [key], "t_ms", chunk, ["t_ms"], tie=tie)
    gap = (_d("t_ms") - _d("prev_t_ms")) / 1000.0
    ibi = F.when(gap > 0, gap)
    agg = seq2.groupBy(key).agg(
        F.count(F.lit(1)).alias("blinks"), F.sum("dur").alias("dur"), F.count(ibi).cast("double").alias("k"), F.sum(ibi).alias("s"), F.sum(ibi * ibi).alias("ss")
    )
    count = F.coalesce(F.col("blinks"), F.lit(0))
    enough = F.col("n") >= 15
    return span.join(agg, key, "left").select(
        key,
        F.when(enough, F.when(F.col("span") > 0, half_up(count / (F.col("span") / 1000.0) * 60, 2)).otherwise(F.lit(0.0))).alias("blink_rate"),
        F.when(enough, F.when(F.col("k") >= 2, half_up(_pop_cv(F.col("k"), F.col("s"), F.col("ss")), 4)).otherwise(F.lit(0.0))).alias("blink_interval_variability"),
        F.when(enough & (count > 0), half_up(F.col("dur") / count, 2)).alias("blink_duration_mean"),
        F.when(enough, count).otherwise(0).alias("blink_count"),
    )


def gaze_features(gaze: DataFrame, key: str = KEY, chunk: float = CHUNK, tie: str | None = None) -> DataFrame:
    """Velocity between samples more than 5 ms apart, its jitter and smoothness, and distance to the target."""
    extra = [tie] if tie else []
    seq = sequenced(gaze, [key], "t_ms", chunk, ["t_ms", "gaze_x", "gaze_y"], tie=tie)
    dt = (_d("t_ms") - _d("prev_t_ms")) / 1000.0
    dx, dy = _d("gaze_x") - _d("prev_gaze_x"), _d("gaze_y") - _d("prev_gaze_y")
    ex, ey = _d("gaze_x") - _d("target_x"), _d("gaze_y") - _d("target_y")
    moves = seq.where(dt > 0.005).select(key, "t_ms", *extra, (F.sqrt(dx * dx + dy * dy) / dt).alias("vel"), (ex * ex + ey * ey).alias("err2"))
    acc = sequenced(moves, [key], "t_ms", chunk, ["vel"], tie=tie)
    counts = gaze.groupBy(key).agg(F.count(F.lit(1)).alias("sample_count"))
    g = acc.groupBy(key).agg(
        F.avg("vel").alias("mean_v"),
        F.max("vel").alias("max_v"),
        F.avg(F.abs(F.col("vel") - F.col("prev_vel"))).alias("jitter"),
        F.when(F.count("vel") >= 2, F.stddev_pop("vel")).otherwise(F.lit(0.0)).alias("sd_v"),
        F.avg("err2").alias("mse"),
        F.avg(F.sqrt("err2")).alias("err"),
    )
    ok = F.col("sample_count") >= 10
    rmse = F.coalesce(F.sqrt("mse"), F.lit(1.0))
    zero = F.lit(0.0)
    return counts.join(g, key, "left").select(
        key,
        "sample_count",
        F.when(ok, round4(1 / (1 + 0.15 * F.coalesce("jitter", zero)))).alias("gaze_stability"),
        F.when(ok, round4(F.exp(-2.5 * rmse))).alias("tracking_accuracy"),
        F.when(ok, round4(F.coalesce("mean_v", zero))).alias("mean_velocity"),
        F.when(ok, round4(F.coalesce("max_v", zero))).alias("max_velocity"),
        F.when(ok, round4(1 / (1 + 0.1 * F.coalesce("sd_v", zero)))).alias("smoothness"),
        F.when(ok, round4(F.coalesce("err", zero))).alias("tracking_error_mean"),
        F.when(ok, round4(rmse)).alias("rmse"),
    )


def reaction_features(events: DataFrame, key: str = KEY) -> DataFrame:
    """Responses within 100-2500 ms; untapped, timed-out or later ones are misses, earlier ones neither."""
    tapped = F.coalesce(F.col("tapped"), F.lit(False)) & ~F.coalesce(F.col("timeout"), F.lit(False)) & (F.coalesce(F.col("response_ms"), F.lit(0)) != 0)
    rt = F.when(tapped, _d("response_ms") - _d("stimulus_ms"))
    valid = F.when(rt.between(100, 2500), rt)
    g = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_targets"),
        F.count_if(~tapped | (rt > 2500)).alias("missed_targets"),
        F.count(valid).alias("valid_responses"),
        F.sum(valid).alias("s"),
        F.sum(valid * valid).alias("ss"),
    )
    n = _d("valid_responses")
    return g.select(
        key,
        "total_targets",
        "missed_targets",
        "valid_responses",
        F.when(n > 0, half_up(F.col("s") / n, 2)).alias("reaction_time_mean"),
        F.when(n >= 2, half_up(_pop_cv(n, F.col("s"), F.col("ss")), 4)).otherwise(F.lit(0.0)).alias("reaction_time_variability"),
    )


# ---- voice -----------------------------------------------------------------------------------------------------

def voice_perturbation(frames: DataFrame, key: str = KEY, chunk: float = 10_000.0, tie: str | None = None) -> DataFrame:
    """Jitter and shimmer (mean absolute step between neighbouring frames over the mean) and pitch statistics."""
    seq = sequenced(frames, [key], "frame", chunk, ["period_s", "peak_amp"], tie=tie)

    def relative(c: str) -> Column:
        diff, mean = F.avg(F.abs(_d(c) - _d(f"prev_{c}"))), F.avg(_d(c))
        return F.when((F.count(c) < 2) | (mean <= 1e-6), F.lit(0.0)).otherwise(diff / mean)

    g = seq.groupBy(key).agg(
        relative("period_s").alias("jitter"), relative("peak_amp").alias("shimmer"), F.avg("f0").alias("pitch_mean"), F.stddev_pop("f0").alias("pitch_std")
    )
    return g.select(key, *[round4(F.col(c)).alias(c) for c in ("jitter", "shimmer", "pitch_mean", "pitch_std")])


def voice_energy(frames: DataFrame, key: str = KEY) -> DataFrame:
    """Silence ratio and signal-to-noise ratio from frame RMS; silent is below max(0.005, 8 % of the loudest frame)."""
    peak = frames.groupBy(key).agg(F.max("rms").alias("peak"))
    f = frames.join(peak, key).withColumn("silent", F.col("rms") < F.greatest(F.lit(0.005), F.col("peak") * 0.08))
    power = F.col("rms") * F.col("rms")
    g = f.groupBy(key).agg(
        F.avg(F.col("silent").cast("double")).alias("silence_ratio"),
        F.coalesce(F.avg(F.when(~F.col("silent"), power)), F.lit(1e-6)).alias("voiced"),
        F.coalesce(F.avg(F.when(F.col("silent"), power)), F.lit(1e-6)).alias("noise"),
    )
    snr = 10 * F.log10(F.greatest(F.lit(1e-4), F.col("voiced") / F.col("noise")))
    return g.select(key, round4(F.col("silence_ratio")).alias("silence_ratio"), round4(snr).alias("snr_db"))


def recording_qc(frames: DataFrame, key: str = KEY, sample_rate: float = 16000.0) -> DataFrame:
    """Quality verdict per recording from per-frame sums (n, sum_sq, clipped, crossings, silent)."""
    g = frames.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "sum_sq", "clipped", "crossings")], F.avg(F.col("silent").cast("double")).alias("silence"))
    n = _d("n")
    out = g.select(
        key,
        round_half_away(n / sample_rate, 3).alias("duration_sec"),
        round4(F.col("silence")).alias("silence_ratio"),
        round_half_away(F.col("clipped") / n, 5).alias("clipping_ratio"),
        round_half_away(F.sqrt(F.col("sum_sq") / n), 6).alias("rms_energy"),
        round4(F.col("crossings") / F.greatest(n - 1, F.lit(1.0))).alias("zero_crossing_rate"),
    )
    issues = reasons(
        (F.col("duration_sec") < 1.0, "duration"),
        (F.col("silence_ratio") > 0.90, "silence"),
        (F.col("clipping_ratio") > 0.01, "clipping"),
        (F.col("rms_energy") < 1e-4, "energy"),
        (F.col("zero_crossing_rate") > 0.60, "noise"),
    )
    return out.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


# ---- tremor ----------------------------------------------------------------------------------------------------

# Frequency bands in Hz: name, from (inclusive), to (exclusive).
TREMOR_BANDS = [("physiological", 0.5, 3.0), ("pathological", 3.0, 8.0), ("essential", 4.0, 12.0), ("high_frequency", 8.0, 20.0)]
DOMINANT_BAND = (3.0, 12.0)


def tremor_spectrum(acc: DataFrame, key: str = KEY, rate_hz: float = 50.0, chunk: float = CHUNK, tie: str | None = None) -> DataFrame:
    """Dominant 3-12 Hz frequency, band-power ratios of the Hann-weighted signal and true band RMS.

    The bins of 0.5-20 Hz come from a four-step transform of the zero-padded recording, so a recording of any length is spread over
    tasks; total power comes from Parseval. A recording of fewer than 10 samples has null features and the status
    'insufficient_samples'.
    """
    sig = with_magnitude(acc)
    moments = signal_moments(sig, key, "mag")
    stats = moments.where("n_samples >= 10").withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_samples").cast("double")))))
    seq = sequenced(sig.select(key, "t_ms", "mag", *([tie] if tie else [])), [key], "t_ms", chunk, tie=tie, carried=stats)
    dev = F.col("mag") - F.col("mean")
    hann = dev * 0.5 * (1 - F.cos(2 * math.pi * _d("idx") / (F.col("n_samples") - 1)))
    spec = power_bins(seq.select(key, "size", "n_samples", "idx", hann.alias("w"), dev.alias("d")), [key, "size", "n_samples"], "size", "idx", ["w", "d"], 0.5 / rate_hz, 20.0 / rate_hz)
    freq = F.col("bin") * rate_hz / F.col("size")
    spec = spec.withColumns(
        {
            "freq": freq,
            "power": 2 * F.col("w") / F.col("size"),
            "raw": 2 * F.col("d") / F.col("size"),
        }
    )
    inside = F.col("freq").between(*DOMINANT_BAND)
    total = seq.groupBy(key).agg(F.sum(hann * hann).alias("total"))
    g = spec.groupBy(key, "n_samples").agg(
        F.max_by(F.when(inside, F.col("freq")), F.when(inside, F.struct("power", -F.col("freq")))).alias("dominant"),
        F.max(F.when(inside, F.col("power"))).alias("peak"),
        F.sum(F.when(inside, F.col("raw"))).alias("band"),
        *[F.coalesce(F.sum(F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.col("power"))), F.lit(0.0)).alias(name) for name, lo, hi in TREMOR_BANDS],
    )
    ratio = [F.when(F.col("total") > 0, round4(F.col(name) / F.col("total"))).when(F.col("total").isNotNull(), F.lit(0.0)).alias(name) for name, _, _ in TREMOR_BANDS]
    return moments.select(key, F.col("n_samples").alias("_n")).join(g.join(total, key), key, "left").select(
        key,
        F.when(F.col("_n") < 10, "insufficient_samples").otherwise("ok").alias("status"),
        round_half_away(F.col("dominant"), 3).alias("dominant_frequency"),
        round4(F.col("peak")).alias("peak_power"),
        round4(F.sqrt(F.col("band") / F.col("n_samples"))).alias("tremor_amplitude"),
        *ratio,
    )
