"""D: recording features. Every participant's events form one recording; a minute of event time counts as a millisecond."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import signals as sg
from driftwell.plans import tables as tb
from driftwell.plans.quality_queries import _errs
from driftwell.plans.registry import query
from driftwell.plans.sqltext import SESSIONS, r4, rn

CHUNK = 9_000.0
EPOCH_MINUTES = 28401120
OPT = {"key": "session_id", "chunk": CHUNK, "tie": "event_id"}


def samples(spark, sf):
    s = tb.sessions(spark, sf)
    minutes = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 6e7) - EPOCH_MINUTES
    return s.select(F.col("participant_id").alias("session_id"), "event_id", minutes.alias("t_ms"), "value", "k", "modality")


SMP = f"""{SESSIONS},
smp AS (SELECT participant_id AS session_id, event_id, CAST(floor(epoch(ts)/60) AS BIGINT) - {EPOCH_MINUTES} AS t_ms, value, k, modality FROM sessions)"""
W = "(PARTITION BY session_id ORDER BY t_ms, event_id)"


def hu(e: str, d: int) -> str:
    return f"(floor(({e})*1e{d}+0.5)/1e{d})"


def cv(n: str, s: str, ss: str) -> str:
    return f"CASE WHEN {s} <> 0 THEN sqrt(greatest(({n}*{ss}-{s}*{s})/({n}*{n}), 0e0))/({s}/{n}) ELSE 0e0 END"


@query(
    "D1_typing_features",
    f"""WITH {SMP}, q AS (SELECT *, CAST(t_ms - lag(t_ms) OVER {W} AS DOUBLE) AS iki FROM smp),
g AS (SELECT session_id, count(*) AS kc, (max(t_ms)-min(t_ms))/1e3 AS dur, count(iki) AS n, sum(iki) AS s, sum(iki*iki) AS ss, count(*) FILTER (iki > 500) AS pc, count(*) FILTER (k < 10) AS cc FROM q GROUP BY ALL),
m AS (SELECT *, CASE WHEN n > 0 THEN {hu("s/n", 2)} ELSE 0e0 END AS mean FROM g),
d AS (SELECT *, CASE WHEN n > 1 THEN {hu("sqrt(greatest((ss-2e0*mean*s+n*mean*mean)/(n-1), 0e0))", 2)} ELSE 0e0 END AS sd FROM m)
SELECT session_id, kc AS keystroke_count, CASE WHEN dur > 0 THEN {hu("kc/dur", 3)} ELSE 0e0 END AS typing_speed, mean AS mean_inter_key_interval, sd AS std_inter_key_interval,
  CASE WHEN dur > 0 THEN {hu("pc/(dur/6e1)", 2)} ELSE 0e0 END AS pause_rate, CASE WHEN dur > 0 THEN {hu("cc/(dur/6e1)", 2)} ELSE 0e0 END AS correction_rate,
  CASE WHEN mean > 0 THEN {hu("sd/mean", 4)} ELSE 0e0 END AS rhythm_variability FROM d""",
)
def typing_features(spark, sf):
    s = samples(spark, sf).withColumn("is_correction", F.col("k") < 10)
    return sg.typing_features(s, **OPT)


@query(
    "D2_key_intervals",
    f"""WITH {SMP} SELECT session_id, event_id AS press_id, row_number() OVER {W} - 1 AS idx, CAST(k AS DOUBLE) AS hold_ms,
  CAST(coalesce(t_ms - lag(t_ms) OVER {W}, 0) AS DOUBLE) AS iki_ms FROM smp""",
)
def key_intervals(spark, sf):
    s = samples(spark, sf)
    both = F.array(
        F.struct(F.lit("down").alias("kind"), F.col("t_ms").alias("t_ms")), F.struct(F.lit("up").alias("kind"), (F.col("t_ms") + F.col("k")).alias("t_ms"))
    )
    events = s.select("session_id", F.col("event_id").alias("press_id"), F.inline(both))
    return sg.key_intervals(events, "session_id", CHUNK)


@query(
    "D3_tapping_features",
    f"""WITH {SMP}, q AS (SELECT *, CAST(t_ms - lag(t_ms) OVER {W} AS DOUBLE) AS iti FROM smp),
t AS (SELECT session_id, count(*) AS taps, (max(t_ms)-min(t_ms))/1e3 AS sec FROM q GROUP BY ALL),
v AS (SELECT session_id, iti AS y, CAST(row_number() OVER {W} - 1 AS DOUBLE) AS x FROM q WHERE iti BETWEEN 50 AND 2000),
g AS (SELECT session_id, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y*y) AS syy, sum(x) AS sx, sum(x*x) AS sxx, sum(x*y) AS sxy FROM v GROUP BY ALL)
SELECT session_id, taps AS tap_count, {hu("taps/sec", 3)} AS tapping_rate, {hu("sy/n", 2)} AS interval_mean, {hu(cv("n", "sy", "syy"), 4)} AS interval_variability,
  {hu("(n*sxy-sx*sy)/(n*sxx-sx*sx)", 4)} AS decline_slope, 'ok' AS status FROM t JOIN g USING (session_id)""",
)
def tapping_features(spark, sf):
    return sg.tapping_features(samples(spark, sf), **OPT)


ACC = f"""{SMP}, acc AS (SELECT session_id, event_id, t_ms, sqrt(value*value + (CAST(k AS DOUBLE)*k + 1e0)) AS mag FROM smp),
st AS (SELECT session_id, avg(mag) AS mean, stddev_pop(mag) AS sd, count(*) AS n, max(t_ms)-min(t_ms) AS span FROM acc GROUP BY ALL),
nb AS (SELECT acc.*, lag(mag) OVER {W} AS p, lead(mag) OVER {W} AS x FROM acc),
cand AS (SELECT DISTINCT session_id, t_ms AS t FROM nb JOIN st USING (session_id) WHERE mag > p AND mag > x AND mag-mean > 0.3::DOUBLE*sd AND n >= 20),
nxt AS (SELECT session_id, t, min(t) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN 250 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM cand),
peaks AS (WITH RECURSIVE r(session_id, t) AS (SELECT session_id, min(t) FROM cand GROUP BY 1 UNION ALL SELECT r.session_id, n.nt FROM r JOIN nxt n ON n.session_id = r.session_id AND n.t = r.t WHERE n.nt IS NOT NULL) SELECT * FROM r)"""


def _acc(spark, sf):
    return samples(spark, sf).select("session_id", "event_id", "t_ms", F.col("value").alias("ax"), F.col("k").alias("ay"), F.lit(1.0).alias("az"))


@query("D4_walking_peaks", f"WITH {ACC} SELECT session_id, CAST(t AS DOUBLE) AS t_ms FROM peaks")
def walking_peaks(spark, sf):
    return sg.walking_peaks(_acc(spark, sf), **OPT)


WALK = f"""{ACC},
iv AS (SELECT session_id, t, CAST(t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS DOUBLE) AS step FROM peaks),
vs AS (SELECT session_id, step, row_number() OVER (PARTITION BY session_id ORDER BY t) - 1 AS i FROM iv WHERE step BETWEEN 250 AND 2000),
pr AS (SELECT session_id, i//2 AS j, count(*) AS c, sum(step) AS tot, max(step) FILTER (i%2=0) AS ev, max(step) FILTER (i%2=1) AS od FROM vs GROUP BY ALL),
ag AS (SELECT session_id, sum(c) AS n_steps, CAST(count(*) FILTER (c=2) AS DOUBLE) AS ns, sum(tot) FILTER (c=2) AS s, sum(tot*tot) FILTER (c=2) AS ss, avg(ev) AS em, avg(od) AS om FROM pr GROUP BY ALL),
pk AS (SELECT session_id, count(*) AS peaks FROM peaks GROUP BY ALL),
w0 AS (SELECT st.*, peaks, n_steps, ns, s, ss, em, om, CASE WHEN n < 20 THEN 'insufficient_samples' WHEN coalesce(peaks,0) < 2 THEN 'insufficient_peaks' WHEN coalesce(n_steps,0) < 2 THEN 'insufficient_valid_steps' ELSE 'ok' END AS status
  FROM st LEFT JOIN pk USING (session_id) LEFT JOIN ag USING (session_id)),
w1 AS (SELECT *, CAST(floor((s/ns)/(span/CAST(n AS DOUBLE))+0.5) AS BIGINT) AS lg FROM w0),
ix AS (SELECT acc.session_id, mag-mean AS dev, row_number() OVER {W} - 1 AS i, lg, status FROM acc JOIN w1 USING (session_id)),
ac AS (SELECT a.session_id, sum(a.dev*b.dev) AS num, sum(a.dev*a.dev) AS den FROM ix a JOIN ix b ON a.session_id = b.session_id AND b.i = a.i + a.lg WHERE a.lg > 0 AND a.status = 'ok' GROUP BY ALL),
w2 AS (SELECT w1.*, CASE WHEN den > 0 THEN (num/den+1)/2 ELSE 0e0 END AS au FROM w1 LEFT JOIN ac USING (session_id))"""


@query(
    "D4_walking_features",
    f"""WITH {WALK}
SELECT session_id, CASE WHEN status = 'ok' THEN {hu("peaks/(span/1e3)*6e1", 2)} END AS cadence, CASE WHEN status = 'ok' THEN {hu("s/ns/1e3", 4)} END AS stride_interval_mean,
  CASE WHEN status = 'ok' THEN CASE WHEN ns > 1 THEN {hu(cv("ns", "s", "ss"), 4)} ELSE 0e0 END END AS stride_interval_variability,
  CASE WHEN status = 'ok' THEN {hu("least(greatest(au, 0e0), 1e0)", 4)} ELSE 0e0 END AS movement_regularity,
  CASE WHEN status = 'ok' THEN {hu("1-abs(em-om)/((em+om)/2)", 4)} END AS symmetry_index, CASE WHEN status = 'ok' THEN peaks ELSE 0 END AS step_count, status FROM w2""",
)
def walking_features(spark, sf):
    return sg.walking_features(_acc(spark, sf), **OPT)


@query(
    "D5_autocorr_at",
    f"""WITH {SMP}, ix AS (SELECT session_id, value - avg(value) OVER (PARTITION BY session_id) AS dev, row_number() OVER {W} - 1 AS i FROM smp)
SELECT a.session_id, CAST(3 AS BIGINT) AS lag, {r4("((sum(a.dev*b.dev)/sum(a.dev*a.dev)+1)/2)")} AS autocorr FROM ix a JOIN ix b ON a.session_id = b.session_id AND b.i = a.i + 3 GROUP BY 1""",
)
def autocorr_at(spark, sf):
    s = samples(spark, sf).select("session_id", "event_id", "t_ms", "value")
    lags = s.select("session_id").distinct().withColumn("lag", F.lit(3))
    return sg.autocorr_at(s, lags, **OPT).select("session_id", "lag", sg.round4(F.col("autocorr")).alias("autocorr"))


def _force(spark, sf):
    s = samples(spark, sf)
    return s.select("session_id", "event_id", F.col("t_ms").alias("time"), F.col("value").alias("total_left"), F.col("k").cast("double").alias("total_right"))


RATE = 10.0
FORCE = f"""{SMP}, fo AS (SELECT session_id, t_ms AS time, value AS l, CAST(k AS DOUBLE) AS r, value + k AS total, row_number() OVER {W} - 1 AS i FROM smp),
fs AS (SELECT session_id, avg(total) AS mean, count(*) AS n, CAST(max(time)-min(time) AS DOUBLE) AS dur, max(total) AS pk, var_pop(total) AS vr, avg(l) AS lm, avg(r) AS rm FROM fo GROUP BY ALL),
dv AS (SELECT fo.session_id, i, n, total-mean AS d FROM fo JOIN fs USING (session_id)),
lags AS (SELECT unnest(generate_series(0, 24)) AS g),
pl AS (SELECT a.session_id, a.n, g, sum(a.d*b.d) AS p FROM dv a JOIN lags ON g = 0 OR g >= 2 JOIN dv b ON b.session_id = a.session_id AND b.i = a.i + g GROUP BY ALL),
rg AS (SELECT session_id, n, CASE WHEN n >= 50 THEN {r4("least(greatest(max(p) FILTER (g >= 2 AND g < least(25, n-1))/(max(p) FILTER (g = 0)+1e-12), 0e0), 1e0)")} END AS step_regularity FROM pl GROUP BY session_id, n)"""


def _foot(c: str) -> str:
    return f"""{c}f AS (SELECT session_id, i, CASE WHEN {c} > 0.1::DOUBLE*max({c}) OVER (PARTITION BY session_id) THEN 1 ELSE 0 END AS o FROM fo),
{c}c AS (SELECT session_id, i, o - coalesce(lag(o) OVER (PARTITION BY session_id ORDER BY i), 0) AS ch FROM {c}f),
{c}n AS (SELECT session_id, ch, i - lag(i) OVER w AS stn, lead(i) OVER w - i AS swg FROM {c}c WHERE ch <> 0 WINDOW w AS (PARTITION BY session_id ORDER BY i)),
{c}s AS (SELECT session_id, stn, CASE WHEN swg BETWEEN 2 AND 20 THEN swg END AS swg, stn/1e1 AS stance_s, CASE WHEN swg BETWEEN 2 AND 20 THEN swg/1e1 END AS swing_s FROM {c}n WHERE ch = -1 AND stn BETWEEN 2 AND 20)"""


@query("D6_step_regularity", f"WITH {FORCE} SELECT session_id, step_regularity FROM rg")
def step_regularity(spark, sf):
    from driftwell.operators.ordered import sequenced

    f = _force(spark, sf).withColumn("total", F.col("total_left") + F.col("total_right"))
    return sg.step_regularity(sequenced(f, ["session_id"], "time", CHUNK, tie="event_id"), "session_id", "total", RATE, block=32)


@query("D7_stance_swing", f"WITH {FORCE}, {_foot('l')} SELECT session_id, stance_s, swing_s FROM ls")
def stance_swing(spark, sf):
    from driftwell.operators.ordered import sequenced

    f = sequenced(_force(spark, sf), ["session_id"], "time", CHUNK, tie="event_id")
    return sg.stance_swing(f, "session_id", "total_left", RATE, 16.0).select("session_id", "stance_s", "swing_s")


GAIT_SQL = f"""{FORCE}, {_foot('l')}, {_foot('r')},
both_feet AS (SELECT * FROM ls UNION ALL SELECT * FROM rs),
sp AS (SELECT session_id, count(*) AS st, avg(stn) AS sa, avg(swg) AS sw, count(swg) AS k, avg(stn+swg)*(2e0/1e1) AS m, stddev_pop(stn+swg)*(2e0/1e1) AS sd FROM both_feet GROUP BY ALL),
ga AS (SELECT fs.*, sp.* EXCLUDE (session_id), step_regularity, {r4("m")} AS mr, (lm+rm)/2 AS ce FROM fs LEFT JOIN sp USING (session_id) LEFT JOIN rg USING (session_id)),
gait AS (SELECT session_id, {rn("dur", 2)} AS trial_duration_s, CASE WHEN st >= 2 AND sw > 0 THEN {r4("(sa/sw)")} END AS stance_swing_ratio,
  CASE WHEN st >= 2 AND k >= 2 THEN mr END AS stride_interval_mean_s, CASE WHEN st >= 2 AND k >= 2 THEN {r4("(sd/(m+1e-12)*1e2)")} END AS stride_interval_cv_pct,
  CASE WHEN st >= 2 AND k >= 2 THEN {rn("(k/dur*6e1)", 2)} END AS cadence_steps_per_min, CASE WHEN st >= 2 AND k >= 2 THEN {r4("(0.72::DOUBLE*(1e0/(mr+1e-12)))")} END AS gait_speed_m_per_s,
  CASE WHEN st >= 2 THEN step_regularity END AS step_regularity, CASE WHEN st >= 2 AND pk > 0 THEN {r4("(vr/(pk*pk+1e-12))")} END AS accel_variance,
  CASE WHEN st >= 2 AND ce > 0 THEN {r4("(abs(lm-rm)/ce*1e2)")} END AS symmetry_index_pct FROM ga)"""


@query("D8_gait_features", f"WITH {GAIT_SQL} SELECT * FROM gait")
def gait_features(spark, sf):
    return sg.gait_features(_force(spark, sf), "session_id", RATE, CHUNK, tie="event_id")


@query("D9_motor_features", f"WITH {GAIT_SQL} SELECT session_id, {', '.join(sg.GAIT)} FROM gait")
def motor_features(spark, sf):
    return sg.motor_features(_force(spark, sf), True, "session_id", rate_hz=RATE, chunk=CHUNK, tie="event_id")


@query(
    "D10_blink_features",
    f"""WITH {SMP}, f AS (SELECT *, CASE WHEN k/1e2 < 0.21::DOUBLE THEN 1 ELSE 0 END AS c, max(t_ms) OVER (PARTITION BY session_id) AS last_t FROM smp),
p AS (SELECT *, lag(c) OVER {W} AS pc FROM f), b AS (SELECT *, lead(t_ms) OVER {W} AS nt FROM p WHERE c <> pc OR (pc IS NULL AND c = 1)),
bl AS (SELECT session_id, event_id, t_ms, coalesce(nt, last_t) - t_ms AS dur FROM b WHERE c = 1 AND coalesce(nt, last_t) - t_ms BETWEEN 50 AND 600),
ib AS (SELECT *, (t_ms - lag(t_ms) OVER {W})/1e3 AS g FROM bl),
ag AS (SELECT session_id, count(*) AS blinks, sum(dur) AS dur, CAST(count(*) FILTER (g > 0) AS DOUBLE) AS kk, sum(g) FILTER (g > 0) AS s, sum(g*g) FILTER (g > 0) AS ss FROM ib GROUP BY ALL),
sp AS (SELECT session_id, max(t_ms)-min(t_ms) AS span, count(*) AS n FROM smp GROUP BY ALL)
SELECT session_id, CASE WHEN n >= 15 THEN {hu("coalesce(blinks,0)/(span/1e3)*60", 2)} END AS blink_rate,
  CASE WHEN n >= 15 THEN CASE WHEN kk >= 2 THEN {hu(cv("kk", "s", "ss"), 4)} ELSE 0e0 END END AS blink_interval_variability,
  CASE WHEN n >= 15 AND blinks > 0 THEN {hu("dur/CAST(blinks AS DOUBLE)", 2)} END AS blink_duration_mean, CASE WHEN n >= 15 THEN coalesce(blinks, 0) ELSE 0 END AS blink_count
FROM sp LEFT JOIN ag USING (session_id)""",
)
def blink_features(spark, sf):
    return sg.blink_features(samples(spark, sf).withColumn("ear", F.col("k") / 100.0), **OPT)


@query(
    "D11_gaze_features",
    f"""WITH {SMP}, q AS (SELECT *, (t_ms - lag(t_ms) OVER {W})/1e3 AS dt, value/1e2 - lag(value/1e2) OVER {W} AS dx, k/1e2 - lag(k/1e2) OVER {W} AS dy FROM smp),
m AS (SELECT session_id, event_id, t_ms, sqrt(dx*dx+dy*dy)/dt AS vel, (value/1e2-0.5::DOUBLE)*(value/1e2-0.5::DOUBLE)+(k/1e2-0.5::DOUBLE)*(k/1e2-0.5::DOUBLE) AS e2 FROM q WHERE dt > 0.005::DOUBLE),
a AS (SELECT *, abs(vel - lag(vel) OVER {W}) AS ac FROM m),
g AS (SELECT session_id, avg(vel) AS mv, max(vel) AS xv, avg(ac) AS j, CASE WHEN count(*) >= 2 THEN stddev_pop(vel) ELSE 0e0 END AS sd, sqrt(avg(e2)) AS rmse0, avg(sqrt(e2)) AS er FROM a GROUP BY ALL)
SELECT session_id, (SELECT count(*) FROM smp s WHERE s.session_id = g.session_id) AS sample_count, {r4("(1/(1+0.15::DOUBLE*coalesce(j,0e0)))")} AS gaze_stability,
  {r4("exp(-2.5::DOUBLE*rmse0)")} AS tracking_accuracy, {r4("mv")} AS mean_velocity, {r4("xv")} AS max_velocity, {r4("(1/(1+0.1::DOUBLE*sd))")} AS smoothness, {r4("er")} AS tracking_error_mean, {r4("rmse0")} AS rmse FROM g""",
)
def gaze_features(spark, sf):
    s = samples(spark, sf)
    gaze = s.select("session_id", "event_id", "t_ms", (F.col("value") / 100).alias("gaze_x"), (F.col("k") / 100).alias("gaze_y"), F.lit(0.5).alias("target_x"), F.lit(0.5).alias("target_y"))
    return sg.gaze_features(gaze, **OPT)


@query(
    "D12_reaction_features",
    f"""WITH {SMP}, e AS (SELECT session_id, k >= 10 AND k < 95 AS tapped, CAST(floor(value*20) AS DOUBLE) AS rt0 FROM smp), v AS (SELECT *, CASE WHEN tapped AND rt0 + 100 <> 0 THEN rt0 END AS rt FROM e),
g AS (SELECT session_id, count(*) AS tt, count(*) FILTER (rt IS NULL OR rt > 2500) AS ms, count(*) FILTER (rt BETWEEN 100 AND 2500) AS n, sum(rt) FILTER (rt BETWEEN 100 AND 2500) AS s, sum(rt*rt) FILTER (rt BETWEEN 100 AND 2500) AS ss FROM v GROUP BY ALL)
SELECT session_id, tt AS total_targets, ms AS missed_targets, n AS valid_responses, CASE WHEN n > 0 THEN {hu("s/n", 2)} END AS reaction_time_mean, CASE WHEN n >= 2 THEN {hu(cv("n", "s", "ss"), 4)} ELSE 0e0 END AS reaction_time_variability FROM g""",
)
def reaction_features(spark, sf):
    s = samples(spark, sf)
    ev = s.select("session_id", (F.col("k") >= 10).alias("tapped"), (F.col("k") >= 95).alias("timeout"), F.lit(100.0).alias("stimulus_ms"), (F.floor(F.col("value") * 20) + 100).alias("response_ms"))
    return sg.reaction_features(ev, "session_id")


@query(
    "D13_voice_perturbation",
    f"""WITH {SMP}, q AS (SELECT *, abs(value - lag(value) OVER {W}) AS dv, abs(k - lag(k) OVER {W}) AS dk FROM smp),
g AS (SELECT session_id, avg(dv)/avg(value) AS j, avg(dk)/avg(k) AS s, avg(value) AS pm, stddev_pop(value) AS ps FROM q GROUP BY ALL)
SELECT session_id, {r4("j")} AS jitter, {r4("s")} AS shimmer, {r4("pm")} AS pitch_mean, {r4("ps")} AS pitch_std FROM g""",
)
def voice_perturbation(spark, sf):
    s = samples(spark, sf)
    frames = s.select("session_id", "event_id", F.col("t_ms").alias("frame"), F.col("value").alias("period_s"), F.col("k").alias("peak_amp"), F.col("value").alias("f0"))
    return sg.voice_perturbation(frames, **OPT)


@query(
    "D14_voice_energy",
    f"""WITH {SMP}, f AS (SELECT session_id, value/1e3 AS r, max(value/1e3) OVER (PARTITION BY session_id) AS mx FROM smp), s AS (SELECT *, r < greatest(0.005::DOUBLE, mx*0.08::DOUBLE) AS si FROM f),
g AS (SELECT session_id, avg(CAST(si AS DOUBLE)) AS sr, coalesce(avg(r*r) FILTER (NOT si), 1e-6) AS v, coalesce(avg(r*r) FILTER (si), 1e-6) AS n FROM s GROUP BY ALL)
SELECT session_id, {r4("sr")} AS silence_ratio, {r4("(10*log10(greatest(1e-4, v/n)))")} AS snr_db FROM g""",
)
def voice_energy(spark, sf):
    return sg.voice_energy(samples(spark, sf).select("session_id", (F.col("value") / 1e3).alias("rms")), "session_id")


@query(
    "D15_recording_qc",
    f"""WITH {SMP}, g AS (SELECT session_id, CAST(sum(100+k) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS sq, CAST(sum(k//50) AS DOUBLE) AS c, CAST(sum(k) AS DOUBLE) AS x, avg(CASE WHEN k < 90 THEN 1e0 ELSE 0e0 END) AS si FROM smp GROUP BY ALL),
o AS (SELECT session_id, {rn("(n/1e4)", 3)} AS duration_sec, {r4("si")} AS silence_ratio, {rn("(c/n)", 5)} AS clipping_ratio, {rn("sqrt(sq/n)", 6)} AS rms_energy, {r4("(x/(n-1))")} AS zero_crossing_rate FROM g)
SELECT *, {_errs(("duration_sec < 1", "duration"), ("silence_ratio > 0.9::DOUBLE", "silence"), ("clipping_ratio > 0.01::DOUBLE", "clipping"), ("rms_energy < 1e-4", "energy"), ("zero_crossing_rate > 0.6::DOUBLE", "noise"))} AS issues,
  NOT (duration_sec < 1 OR silence_ratio > 0.9::DOUBLE OR clipping_ratio > 0.01::DOUBLE OR zero_crossing_rate > 0.6::DOUBLE) AS passed FROM o""",
)
def recording_qc(spark, sf):
    k = F.col("k")
    frames = samples(spark, sf).select("session_id", (100 + k).alias("n"), k.alias("sum_sq"), F.floor(k / 50).alias("clipped"), k.alias("crossings"), (k < 90).alias("silent"))
    return sg.recording_qc(frames, "session_id", 10000.0)


_ratio = ", ".join(f"coalesce(sum(pw) FILTER (fq >= {lo}::DOUBLE AND fq < {hi}::DOUBLE), 0e0) AS {name}" for name, lo, hi in sg.TREMOR_BANDS)
_out = ", ".join(r4(f"({name}/total)") + f" AS {name}" for name, _, _ in sg.TREMOR_BANDS)


@query(
    "D16_tremor_spectrum",
    f"""WITH {ACC}, z AS (SELECT *, CAST(pow(2, ceil(log2(n))) AS DOUBLE) AS size FROM st WHERE n >= 10),
s AS (SELECT session_id, n, size, CAST(row_number() OVER {W} - 1 AS DOUBLE) AS i, mag-mean AS d FROM acc JOIN z USING (session_id)),
h AS (SELECT *, d*0.5*(1-cos(2*pi()*i/(n-1))) AS w FROM s),
e AS (SELECT *, unnest(generate_series(CAST(ceil(0.5::DOUBLE/5e1*size) AS BIGINT), CAST(floor(2e1/5e1*size) AS BIGINT))) AS bin FROM h),
a AS (SELECT *, 2*pi()*((i*bin) % size)/size AS an FROM e),
p AS (SELECT session_id, n, size, bin, bin*5e1/size AS fq, 2*(pow(sum(w*cos(an)),2)+pow(sum(w*sin(an)),2))/size AS pw, 2*(pow(sum(d*cos(an)),2)+pow(sum(d*sin(an)),2))/size AS rw FROM a GROUP BY session_id, n, size, bin),
tt AS (SELECT session_id, sum(w*w) AS total FROM h GROUP BY ALL),
g AS (SELECT session_id, n, arg_max(fq, pw) FILTER (fq BETWEEN 3 AND 12) AS dom, max(pw) FILTER (fq BETWEEN 3 AND 12) AS pk, sum(rw) FILTER (fq BETWEEN 3 AND 12) AS bd, {_ratio} FROM p GROUP BY ALL)
SELECT session_id, CASE WHEN st.n < 10 THEN 'insufficient_samples' ELSE 'ok' END AS status, {rn("dom", 3)} AS dominant_frequency, {r4("pk")} AS peak_power, {r4("sqrt(bd/g.n)")} AS tremor_amplitude, {_out} FROM st LEFT JOIN g USING (session_id) LEFT JOIN tt USING (session_id)""",
)
def tremor_spectrum(spark, sf):
    return sg.tremor_spectrum(_acc(spark, sf), **OPT)
