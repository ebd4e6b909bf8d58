"""Queries of the event, session and feature operators over the generic event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import features as X
from ..operators import sessions as Z
from ..sources import telemetry as T
from . import oracle_base as O
from .catalog import ORACLES, QUERIES


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def sessions(spark, sf_dir) -> DataFrame:
    return Z.sessionize(T.fixture(spark, sf_dir))


def split_sessions(spark, sf_dir) -> DataFrame:
    """The same by a scan in two levels, so that no connector's history is one task's work."""
    return Z.sessionize(T.fixture(spark, sf_dir), bucket_s=600.0)


def busy_sessions(spark, sf_dir) -> DataFrame:
    """Long sessions from the same events: ten stations talk as one and nobody stops the dialog; faults are stated by odd ones only."""
    number = F.expr("CAST(substr(station, 3) AS INT) DIV 10")
    rows = T.fixture(spark, sf_dir).where("NOT (kind = 'v2g' AND msg LIKE 'SessionStop%')").withColumn("station", F.format_string("ST%04d", number))
    odd = F.substring("station", 3, 10).cast("int") % 2 == 1
    return Z.sessionize(rows.withColumns({c: F.when(odd, F.col(c)).otherwise("") for c in ("resp_code", "evse_status", "isolation", "ev_err")}))


def dense_sessions(spark, sf_dir) -> DataFrame:
    """Busy sessions in a fortieth of the time, so that rows follow without gaps; pre-charge answers repeat a target that is never met."""
    number = F.expr("CAST(substr(station, 3) AS INT) DIV 10")
    odd = number % 2 == 1
    rows = T.fixture(spark, sf_dir).where("NOT (kind = 'v2g' AND msg LIKE 'SessionStop%')")
    rows = rows.withColumns({c: F.when(odd, F.col(c)).otherwise("") for c in ("resp_code", "evse_status", "isolation", "ev_err")})
    target = F.when(F.col("msg") == "PreChargeRes", F.col("evse_v") + 40).otherwise(F.col("ev_target_v"))
    return Z.sessionize(rows.withColumns({"station": F.format_string("ST%04d", number), "t": F.col("t") / 40, "ev_target_v": target}))


def tracked(spark, sf_dir) -> DataFrame:
    return X.tracked(sessions(spark, sf_dir))


def micros(*names: str):
    """Columns of seconds as whole microseconds, which compare exactly."""
    return [F.round(F.col(n) * 1e6).cast("bigint").alias(f"{n}_us") for n in names]


def us(*names: str) -> str:
    return ", ".join(f"CAST(round({n} * 1e6) AS BIGINT) AS {n}_us" for n in names)


@query("a1_read_telemetry", f"WITH {O.TEL} SELECT station, connector, kind, count(*) AS n, count(evse_v) AS n_v, count(ev_target_v) AS n_target, min(msg) AS first_msg, max(msg) AS last_msg FROM tel GROUP BY ALL")
def a1(s, d):
    return T.fixture(s, d).groupBy("station", "connector", "kind").agg(F.count("*").alias("n"), F.count("evse_v").alias("n_v"), F.count("ev_target_v").alias("n_target"), F.min("msg").alias("first_msg"), F.max("msg").alias("last_msg"))


@query("a4_extra_get", f"WITH {O.TEL} SELECT seq, CAST(k AS VARCHAR) AS k, source, CAST(NULL AS VARCHAR) AS missing FROM tel")
def a4(s, d):
    return T.fixture(s, d).select("seq", S.extra_get(F.col("extra"), "k").alias("k"), S.extra_get(F.col("extra"), "source").alias("source"), S.extra_get(F.col("extra"), "absent").alias("missing"))


_LIMITS = " UNION ALL ".join(f"SELECT '{m}' AS msg, {v}::DOUBLE AS lim" for m, v in {**K.MSG_TIMEOUT_S, **K.RES_PERFORMANCE_S}.items())


@query("a12_constants", f"WITH {O.TEL}, lim AS ({_LIMITS}) SELECT msg, lim AS limit_s, count(*) AS n FROM tel JOIN lim USING (msg) GROUP BY ALL")
def a12(s, d):
    return T.fixture(s, d).join(F.broadcast(K.message_limits(s)), "msg").groupBy("msg", "limit_s").agg(F.count("*").alias("n"))


@query("b1_is_activity", f"WITH {O.SES} SELECT kind, msg, act AS activity, count(*) AS n FROM s0 GROUP BY ALL")
def b1(s, d):
    return T.fixture(s, d).withColumn("activity", S.is_activity(F.col("kind"), F.col("msg"))).groupBy("kind", "msg", "activity").agg(F.count("*").alias("n"))


@query("b2_is_decision", f"WITH {O.TEL} SELECT station, count(*) AS n FROM tel WHERE NOT (kind = 'hpav' AND contains(msg, 'LINK_STATUS')) GROUP BY ALL")
def b2(s, d):
    return T.fixture(s, d).where(S.is_decision(F.col("kind"), F.col("msg"))).groupBy("station").agg(F.count("*").alias("n"))


_STAGE = "CASE regexp_replace(msg, '(Req|Res)$', '') " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(K.DC_STAGES)) + " END"


@query("b4_msg_parts", f"WITH {O.TEL} SELECT msg, regexp_replace(msg, '(Req|Res)$', '') AS base, CASE WHEN right(msg, 3) IN ('Req', 'Res') THEN right(msg, 3) ELSE '' END AS suffix, {_STAGE} AS stage, count(*) AS n FROM tel GROUP BY ALL")
def b4(s, d):
    m = F.col("msg")
    return T.fixture(s, d).groupBy("msg").agg(F.count("*").alias("n")).select("msg", S.msg_base(m).alias("base"), S.msg_suffix(m).alias("suffix"), S.stage_index(m).alias("stage"), "n")


@query("b5_phase_of", f"WITH {O.TEL} SELECT {O.PHASE} AS phase, count(*) AS n FROM tel WHERE kind = 'v2g' GROUP BY ALL")
def b5(s, d):
    return T.fixture(s, d).where("kind = 'v2g'").groupBy(S.phase_of(F.col("msg")).alias("phase")).agg(F.count("*").alias("n"))


_SEV = "CASE WHEN resp_code LIKE 'FAILED%' THEN 1 ELSE 0 END::DOUBLE AS rc_sev, CASE evse_status WHEN 'EVSE_Malfunction' THEN 1.0 ELSE 0.0 END::DOUBLE AS evse_sev, CASE isolation WHEN 'Fault' THEN 1.0 WHEN 'Warning' THEN 0.4 ELSE 0.0 END::DOUBLE AS isolation_sev, CASE notification WHEN 'StopCharging' THEN 0.4 ELSE 0.0 END::DOUBLE AS notification_sev, CASE WHEN ev_err = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS ev_err_sev"


@query("b6_severities", f"WITH {O.TEL} SELECT seq, {_SEV} FROM tel")
def b6(s, d):
    c = F.col
    return T.fixture(s, d).select("seq", S.rc_severity(c("resp_code")).alias("rc_sev"), S.evse_severity(c("evse_status")).alias("evse_sev"), S.isolation_severity(c("isolation")).alias("isolation_sev"), S.notification_severity(c("notification")).alias("notification_sev"), S.ev_error_severity(c("ev_err")).alias("ev_err_sev"))


@query("b7_markers", f"WITH {O.TEL} SELECT station, count(*) FILTER (resp_code LIKE 'FAILED%') AS failed, count(*) FILTER (isolation IN ('Fault', 'Warning')) AS isolation, count(*) FILTER (ev_err <> '') AS ev_error, count(*) FILTER (validation = 'FAIL') AS invalid, count(*) FILTER (charge_complete = 'true') AS complete FROM tel GROUP BY ALL")
def b7(s, d):
    c = F.col
    return T.fixture(s, d).groupBy("station").agg(F.count_if(S.is_failed(c("resp_code"))).alias("failed"), F.count_if(c("isolation").isin("Fault", "Warning")).alias("isolation"), F.count_if(~c("ev_err").isin("", "NO_ERROR")).alias("ev_error"), F.count_if(S.validation_bad(c("validation"))).alias("invalid"), F.count_if(S.truthy(c("charge_complete"))).alias("complete"))


@query("s1_sessionize", f"WITH {O.SES} SELECT station, connector, sid, count(*) AS n_events, sum(seq)::BIGINT AS seq_sum, {us('min(t)').replace('min(t)_us', 't_start_us')}, CAST(round(max(t) * 1e6) AS BIGINT) AS t_end_us FROM ses GROUP BY ALL")
def s1(s, d):
    at = lambda f, n: F.round(f("t") * 1e6).cast("bigint").alias(n)
    return split_sessions(s, d).groupBy(*Z.SESSION).agg(F.count("*").alias("n_events"), F.sum("seq").alias("seq_sum"), at(F.min, "t_start_us"), at(F.max, "t_end_us"))


@query("s2_reopen", f"WITH {O.SES} SELECT station, connector, count(*) AS n_split FROM s3 WHERE mk = 'O' AND pm = 'S' GROUP BY ALL")
def s2(s, d):
    # sessions that begin with an opener no more than the gap after the activity before them were split
    rows = split_sessions(s, d)
    act = rows.where(S.is_activity(F.col("kind"), F.col("msg"))).withColumn("_p", F.lag("t").over(Z.per(*Z.CONNECTOR))).withColumn("_s", F.lag("sid").over(Z.per(*Z.CONNECTOR)))
    return act.where((F.col("sid") != F.col("_s")) & (F.col("t") - F.col("_p") <= Z.GAP_S)).groupBy(*Z.CONNECTOR).agg(F.count("*").alias("n_split"))


@query("s3_carry_quiet", f"WITH {O.SES} SELECT seq, sid FROM ses WHERE kind = 'hpav' AND contains(msg, 'LINK_STATUS')")
def s3(s, d):
    return split_sessions(s, d).where("kind = 'hpav' AND contains(msg, 'LINK_STATUS')").select("seq", "sid")


@query("s4_drop_noise", f"WITH {O.SES} SELECT station, connector, sid, count(*) AS n_events FROM ses GROUP BY ALL HAVING count(*) FILTER (kind = 'v2g') > 0 OR count(*) FILTER (kind = 'hpav' AND regexp_matches(msg, 'SLAC|ATTEN_CHAR')) >= 3")
def s4(s, d):
    return Z.drop_noise(sessions(s, d)).groupBy(*Z.SESSION).agg(F.count("*").alias("n_events"))


_SPANS = "spans AS (SELECT station, connector, CAST(floor(t / 120) AS BIGINT) AS file, min(t) AS first, max(t) AS last, count(*) AS n_rows, count(*) * 900000 AS size_bytes, arg_min(msg, seq) FILTER (kind = 'v2g') AS first_v2g FROM tel GROUP BY ALL)"


def file_spans(rows: DataFrame) -> DataFrame:
    """First and last time, rows and size of every file of a connector; two minutes of rows stand for a file."""
    return rows.withColumn("file", F.floor(F.col("t") / 120)).groupBy(*Z.CONNECTOR, "file").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n_rows"), (F.count("*") * 900000).alias("size_bytes"), F.min_by(F.when(F.col("kind") == "v2g", F.col("msg")), F.when(F.col("kind") == "v2g", F.col("seq"))).alias("first_v2g"))


@query("a7_file_spans", f"WITH {O.TEL}, {_SPANS} SELECT station, connector, file, {us('first', 'last')}, n_rows, first_v2g FROM spans")
def a7(s, d):
    return file_spans(T.fixture(s, d)).select(*Z.CONNECTOR, "file", *micros("first", "last"), "n_rows", "first_v2g")


@query("s5_dedupe_files", f"WITH {O.TEL}, {_SPANS}, sp AS (SELECT * FROM spans UNION ALL SELECT station, connector, file + 100000, first, last - 1, n_rows, size_bytes, first_v2g FROM spans), m AS (SELECT *, max(last) OVER (PARTITION BY station, connector ORDER BY first, last DESC, n_rows DESC, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp) SELECT station, connector, file, n_rows FROM m WHERE reach IS NULL OR last > reach")
def s5(s, d):
    spans = file_spans(T.fixture(s, d))
    again = spans.withColumn("file", F.col("file") + 100000).withColumn("last", F.col("last") - 1)
    return Z.dedupe_ring_files(spans.unionByName(again)).select(*Z.CONNECTOR, "file", "n_rows")


@query("s6_data_cuts", f"WITH {O.TEL}, {_SPANS}, m AS (SELECT *, lead(first) OVER w AS nx, lead(first_v2g) OVER w AS nm FROM spans WINDOW w AS (PARTITION BY station, connector ORDER BY first, file)) SELECT station, connector, CAST(round(last * 1e6) AS BIGINT) AS cut_us FROM m WHERE nx IS NULL OR (nx - last > 60 AND (size_bytes >= 4500000 OR NOT coalesce(nm IN ('supportedAppProtocolReq', 'SessionSetupReq'), false)))")
def s6(s, d):
    return Z.data_cuts(file_spans(T.fixture(s, d))).select(*Z.CONNECTOR, *micros("cut"))


@query("f1_phase", f"WITH {O.PH} SELECT seq, phase, {us('phase_elapsed', 'session_elapsed')} FROM ph")
def f1(s, d):
    return X.phases(sessions(s, d)).select("seq", "phase", *micros("phase_elapsed", "session_elapsed"))


@query("f2_dt_v2g", f"WITH {O.TRACK} SELECT seq, {us('dt_v2g')} FROM trk")
def f2(s, d):
    return X.dialog_gap(sessions(s, d)).select("seq", *micros("dt_v2g"))


@query("f3_latency", f"WITH {O.TRACK} SELECT seq, {us('req_res_latency')} FROM trk WHERE req_res_latency IS NOT NULL")
def f3(s, d):
    return X.latency(sessions(s, d)).where("req_res_latency IS NOT NULL").select("seq", *micros("req_res_latency"))


_EWM = f"""r0 AS (SELECT *, row_number() OVER ({O.P} {O.O}) - 1 AS n FROM trk WHERE req_res_latency IS NOT NULL),
r1 AS (SELECT station, connector, sid, seq, t, n, req_res_latency AS x FROM r0),
r2 AS (SELECT *, sum(CASE WHEN n = 0 THEN x ELSE 0.05::DOUBLE * x END * pow(0.95::DOUBLE, -n)) OVER ({O.P} {O.O}) * pow(0.95::DOUBLE, n) AS m FROM r1),
r3 AS (SELECT *, lag(m) OVER ({O.P} {O.O}) AS m0 FROM r2),
r4 AS (SELECT *, sum(CASE WHEN n = 0 THEN 0 ELSE 0.05::DOUBLE * 0.95::DOUBLE * (x - m0) * (x - m0) * pow(0.95::DOUBLE, -n) END) OVER ({O.P} {O.O}) * pow(0.95::DOUBLE, n) AS v FROM r3),
r5 AS (SELECT *, lag(v) OVER ({O.P} {O.O}) AS v0 FROM r4)"""


@query("f4_ewm", f"WITH {O.TRACK}, {_EWM} SELECT seq, round(m, 4) AS mean, round(v, 3) AS variance, round(coalesce((x - m0) / greatest(sqrt(v0), 0.005 * abs(m0) + 1e-6), 0), 3) AS z FROM r5")
def f4(s, d):
    rows = X.ewm(X.latency(sessions(s, d)), "req_res_latency", "latency")
    return rows.where("latency_mean IS NOT NULL").select("seq", F.round("latency_mean", 4).alias("mean"), F.round("latency_var", 3).alias("variance"), F.round("latency_z", 3).alias("z"))


@query("f5_retx", f"WITH {O.TRACK} SELECT seq, CAST(retx_60s AS BIGINT) AS retx_60s FROM trk")
def f5(s, d):
    return X.link_health(sessions(s, d)).select("seq", F.col("retx_60s").cast("bigint").alias("retx_60s"))


@query("f6_rst_seen", f"WITH {O.TRACK} SELECT seq, rst_seen FROM trk")
def f6(s, d):
    return X.link_health(sessions(s, d)).select("seq", "rst_seen")


@query("f7_link_gap", f"WITH {O.TRACK} SELECT seq, {us('link_gap')} FROM trk")
def f7(s, d):
    return X.link_health(sessions(s, d)).select("seq", *micros("link_gap"))


@query("f8_slac_attempts", f"WITH {O.TRACK} SELECT seq, CAST(slac_attempts AS BIGINT) AS slac_attempts FROM trk")
def f8(s, d):
    return X.link_health(sessions(s, d)).select("seq", F.col("slac_attempts").cast("bigint").alias("slac_attempts"))


@query("f9_checks", f"WITH {O.TRACK} SELECT seq, CAST(cablecheck_n AS BIGINT) AS cablecheck_n, {us('cablecheck_elapsed', 'precharge_elapsed')} FROM trk")
def f9(s, d):
    return X.charge_checks(X.phases(sessions(s, d))).select("seq", F.col("cablecheck_n").cast("bigint").alias("cablecheck_n"), *micros("cablecheck_elapsed", "precharge_elapsed"))


@query("f10_deviations", f"WITH {O.TRACK} SELECT seq, {us('v_dev', 'i_dev', 'precharge_v_gap')}, v_over FROM trk WHERE evse_v IS NOT NULL")
def f10(s, d):
    return X.electrical(X.phases(sessions(s, d))).where("evse_v IS NOT NULL").select("seq", *micros("v_dev", "i_dev", "precharge_v_gap"), "v_over")


@query("f11_i_collapse", f"WITH {O.TRACK} SELECT seq, i_collapse FROM trk WHERE evse_i IS NOT NULL")
def f11(s, d):
    return X.electrical(X.phases(sessions(s, d))).where("evse_i IS NOT NULL").select("seq", "i_collapse")


@query("f12_battery", f"""WITH {O.SES},
a AS (SELECT seq, soc, t - first_value(t) OVER w AS dt, soc - first_value(soc) OVER w AS ds, remaining_full_min - first_value(remaining_full_min) OVER w AS dr
  FROM ses WHERE soc IS NOT NULL WINDOW w AS ({O.P} {O.O} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT seq, CAST(round(CASE WHEN dt > 0 THEN ds / dt END * 1e6) AS BIGINT) AS soc_rate_us, CAST(round(CASE WHEN dt / 60 > 0.05 THEN dr / (dt / 60) + 1 END * 1e6) AS BIGINT) AS remaining_trend_us FROM a""")
def f12(s, d):
    return X.battery(sessions(s, d)).where("soc IS NOT NULL").select("seq", *micros("soc_rate", "remaining_trend"))


@query("f13_collapse_run", f"WITH {O.TRACK} SELECT seq, CAST(sum(CASE WHEN i_collapse THEN 1 ELSE 0 END) OVER ({O.P}, island {O.O}) AS BIGINT) AS collapse_run FROM trk WHERE evse_i IS NOT NULL")
def f13(s, d):
    return tracked(s, d).where("evse_i IS NOT NULL").select("seq", F.col("collapse_run").cast("bigint").alias("collapse_run"))


@query("f14_phase_durations", f"WITH {O.TRACK} SELECT station, connector, sid, phase, CAST(round((max(t) - min(t)) * 1e6) AS BIGINT) AS seconds_us, count(*) AS n_rows, CAST(round(avg(req_res_latency) * 1e3) AS BIGINT) AS mean_latency_ms FROM trk GROUP BY ALL")
def f14(s, d):
    return X.phase_durations(X.latency(X.phases(sessions(s, d)))).select(*Z.SESSION, "phase", *micros("seconds"), "n_rows", F.round(F.col("mean_latency") * 1e3).cast("bigint").alias("mean_latency_ms"))


_FLAG = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
_WITHIN = lambda c, by, top: f"greatest(least(coalesce({c}, 0) / {by}, {top}), -{top})"
VECTOR_SQL = [
    f"CASE phase {' '.join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(K.PHASES))} END / 6.0", "least(phase_elapsed / 60, 5)", "least(session_elapsed / 600, 5)", "least(coalesce(dt_v2g, 0), 10)", "least(coalesce(req_res_latency, 0) / 0.25, 10)",
    _WITHIN("latency_z", 1, 8), _WITHIN("v_dev", 50, 8), _WITHIN("i_dev", 50, 8), _WITHIN("v_ripple_z", 1, 8), _WITHIN("i_ripple_z", 1, 8), "coalesce(soc, 50) / 100", _WITHIN("soc_rate * 60", 1, 5), "least(coalesce(remaining_full_min, 0) / 60, 5)", _WITHIN("remaining_trend", 1, 5),
    "least(retx_60s / 20.0, 3)", _FLAG("rst_seen"), "least(coalesce(link_gap, 0) / 5, 10)", "least(slac_attempts / 3.0, 3)", "least(cablecheck_n / 40.0, 3)", "least(cablecheck_elapsed / 40, 3)", "least(precharge_elapsed / 7, 3)", _WITHIN("precharge_v_gap", 50, 8),
    "CASE WHEN notification = 'StopCharging' THEN 2.0 ELSE 0.0 END", _FLAG("isolation = 'Warning'"), "len(limit_achieved)", _FLAG("validation = 'FAIL'"), _FLAG("i_collapse"), _FLAG("v_over"), _WITHIN("gap_z", 1, 8),
    _FLAG("resp_code <> ''"), _FLAG("evse_status <> ''"), _FLAG("ev_err <> ''"), _FLAG("isolation = 'Fault'"),
]


def numbers(vector: str, width: int):
    """The numbers of a vector as whole thousandths, a column each, so that order and every number are compared."""
    return [F.round(F.col(vector)[i] * 1e3).cast("bigint").alias(f"x{i:02d}") for i in range(width)]


def numbers_sql(parts: list[str]) -> str:
    return ", ".join(f"CAST(round(({p})::DOUBLE * 1e3) AS BIGINT) AS x{i:02d}" for i, p in enumerate(parts))


def smoothed(spark, sf_dir) -> DataFrame:
    return X.smoothed(tracked(spark, sf_dir))


@query("b10_feature_vector", f"WITH {O.FULL} SELECT seq, {numbers_sql(VECTOR_SQL)} FROM full_trk")
def b10(s, d):
    return X.feature_vector(smoothed(s, d)).select("seq", *numbers("vector", len(VECTOR_SQL)))


@query("b12_narrow", f"WITH {O.FULL} SELECT seq, {numbers_sql(VECTOR_SQL[:12])} FROM full_trk")
def b12(s, d):
    return X.narrow(X.feature_vector(smoothed(s, d)), 12).select("seq", *numbers("vector", 12))


@query("f4_all_series", f"WITH {O.FULL} SELECT seq, " + ", ".join(f"round({n}_z, 3) AS {n}_z" for n in ("latency", "gap", "v_ripple", "i_ripple")) + " FROM full_trk")
def f4_all(s, d):
    return smoothed(s, d).select("seq", *[F.round(f"{n}_z", 3).alias(f"{n}_z") for n in ("latency", "gap", "v_ripple", "i_ripple")])


_TURNS = f"""tu AS (SELECT *, phase <> coalesce(lag(phase) OVER ({O.P} {O.O}), 'idle') AS turned, coalesce(lag(phase) OVER ({O.P} {O.O}), 'idle') AS was FROM full_trk),
tv AS (SELECT *, {O.last("CASE WHEN turned THEN t END", before=True)} AS entered FROM tu)"""


@query("f14_session_observations", f"WITH {O.FULL}, {_TURNS} SELECT station, connector, sid, CAST(round(arg_max(t - entered, (t, seq)) FILTER (turned AND was = 'handshake' AND entered IS NOT NULL) * 1e6) AS BIGINT) AS handshake_s_us, CAST(round(arg_max(t - entered, (t, seq)) FILTER (turned AND was = 'cablecheck' AND entered IS NOT NULL) * 1e6) AS BIGINT) AS cablecheck_s_us, CAST(round(avg(abs(v_ripple_z)) FILTER (phase = 'delivery' AND abs(v_ripple_z) > 0) * 1e3) AS BIGINT) AS mean_ripple_m, bool_or(phase = 'delivery') AS reached_delivery, bool_or(msg = 'SessionStopRes') AS graceful FROM tv GROUP BY ALL")
def f14_sessions(s, d):
    out = X.session_observations(smoothed(s, d))
    return out.select(*Z.SESSION, *micros("handshake_s", "cablecheck_s"), F.round(F.col("mean_ripple") * 1e3).cast("bigint").alias("mean_ripple_m"), "reached_delivery", "graceful")


_TOP = lambda c, by=1: f"greatest(least({c} / {by}, 8), 0)"
CONFORMANCE_SQL = [
    _TOP("msg_timeout_ratio"), _TOP("msg_timeout_max"), _TOP("msg_perf_ratio"), _TOP("n_msg_breach", 5.0), _TOP("seq_gap_s", 40.0), _TOP("seq_gap_s", 60.0), _TOP("n_seq_breach", 3.0), _TOP("ongoing_s", 60.0), _FLAG("ongoing_s >= 55"),
    _TOP("comm_setup_s", 20.0), _TOP("cablecheck_s", 40.0), _FLAG("cablecheck_open AND cablecheck_s >= 40"), _TOP("precharge_s", 7.0), _FLAG("precharge_s >= 7"), _FLAG("seq_illegal"), _TOP("n_seq_illegal", 3.0),
    "greatest(stage_max, 0) / 11.0", _FLAG("stage_regress"), _FLAG("resp_code <> ''"), _FLAG("evse_status <> ''"), "CASE isolation WHEN 'Fault' THEN 1.0 WHEN 'Warning' THEN 0.4 ELSE 0 END", "CASE notification WHEN 'StopCharging' THEN 0.4 ELSE 0 END", _FLAG("ev_err <> ''"),
    "greatest(least(v_over_max, 4), -1)", "greatest(least(i_over_max, 4), -1)", _TOP("precharge_v_gap_ratio"), "least(greatest(dialog - 1, 0), 4)",
]


@query("b11_conformance_vector", f"WITH {O.CONF} SELECT seq, {numbers_sql(CONFORMANCE_SQL)} FROM conf")
def b11(s, d):
    return X.conformance_vector(X.conformance(sessions(s, d))).select("seq", *numbers("conformance_vector", len(CONFORMANCE_SQL)))
