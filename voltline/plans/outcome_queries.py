"""Queries of stop attribution, verdicts, the fault catalogue, policies, re-scoring, the reviewed profile, splits and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as ST
from pyspark.sql import functions as F

from ..functions import catalogue as FC
from ..functions import constants as K
from ..functions import scalars as S
from ..operators import captures as C
from ..operators import detection as D
from ..operators import features as X
from ..operators import labels as G
from ..operators import models as M
from ..operators import reviewed as V
from ..operators import scoring as R
from ..operators import sessions as Z
from ..operators import stateful as SF
from ..operators import training as T
from ..sources import frames
from ..sources import telemetry
from ..streaming import live
from ..streaming import stateful as TS
from ..streaming import upserts as UP
from . import oracle_base as O
from .feature_queries import _TURNS, busy_sessions, dense_sessions, file_spans, micros, query, smoothed, us
from .label_queries import _METRICS, _OUT, _RATES, K3, _names, alerts, all_tools, board, conformance, everything, labels, outcomes, sessions, tracked
from .more_queries import _SPANS
from .catalog import ORACLES
from .tables import scratch, stored

KEYS = list(Z.SESSION)


# ---------------------------------------------------------------- scalars and the catalogue


@query("b3_select_split", f"WITH {O.SES}, {O.FACTS} SELECT 'parts' AS wanted, {K3} FROM fct WHERE contains(station, '01') OR contains(station, '02') UNION ALL SELECT 'main', {K3} FROM fct UNION ALL SELECT 'v2g2024', {K3} FROM fct WHERE false UNION ALL SELECT 'all', {K3} FROM fct")
def b3(s, d):
    index = G.is_session(G.session_facts(sessions(s, d))).select(*KEYS)
    split = T.station_holdout(index)
    picks = [T.select_split(index, split, w).select(F.lit(n).alias("wanted"), *KEYS) for n, w in (("parts", "01, 02"), ("main", "main"), ("v2g2024", "v2g2024"), ("all", "all"))]
    return picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])


@query("b8_station_keys", f"WITH {O.TEL}, y AS (SELECT *, CASE seq % 3 WHEN 0 THEN '2024__' WHEN 1 THEN '2025__' ELSE '' END || station AS key FROM tel) SELECT key AS station, station AS site, CASE left(key, 6) WHEN '2024__' THEN 'v2g2024' WHEN '2025__' THEN 'v2g2025' ELSE 'main' END AS station_group, station || CASE left(key, 6) WHEN '2024__' THEN ' (2024)' WHEN '2025__' THEN ' (2025)' ELSE '' END AS label, count(*) AS n FROM y GROUP BY ALL")
def b8(s, d):
    prefix = F.when(F.col("seq") % 3 == 0, "2024__").when(F.col("seq") % 3 == 1, "2025__").otherwise("")
    rows = telemetry.fixture(s, d).withColumn("station", F.concat(prefix, "station"))
    return rows.groupBy("station").agg(F.count("*").alias("n")).select("station", S.site_of(F.col("station")).alias("site"), S.station_group(F.col("station")).alias("station_group"), S.display_name(F.col("station")).alias("label"), "n")


@query("b8_clock_sanity", f"WITH {O.SES}, {O.FACTS} SELECT station, CAST(year(make_timestamp(CAST(median(t_start) * 1e6 AS BIGINT))) AS INT) AS clock_year FROM fct GROUP BY ALL")
def b8_clock(s, d):
    facts = G.is_session(G.session_facts(sessions(s, d)))
    return facts.groupBy("station").agg(F.percentile("t_start", F.lit(0.5)).alias("m")).select("station", S.clock_year(F.col("m")).alias("clock_year"))


@query("b20_percent_of", f"WITH {O.SES}, {O.LABELS}, g AS (SELECT station, count(*) FILTER (first_fault_family = 'EV_ERROR') AS f, count(first_fault_t) AS n FROM lab GROUP BY ALL) SELECT station, CASE WHEN n > 0 THEN ((2000 * f + n) // (2 * n) // 10) || '.' || ((2000 * f + n) // (2 * n) % 10) || '%' END AS share FROM g")
def b20(s, d):
    g = labels(s, d).groupBy("station").agg(F.count_if(F.col("first_fault_family") == "EV_ERROR").alias("f"), F.count("first_fault_t").alias("n"))
    return g.select("station", S.percent_of(F.col("f"), F.col("n")).alias("share"))


_RESOLVED = "CASE WHEN sid % 2 = 0 THEN guess ELSE CASE guess WHEN 'EVSE_FAULT' THEN CASE WHEN hard THEN guess END WHEN 'ISOLATION_FAULT' THEN guess WHEN 'EV_ERROR' THEN guess WHEN 'SESSION_ABORT' THEN CASE WHEN rst THEN guess END WHEN 'SLAC_FAILURE' THEN guess END END"


@query("b14_resolve_family", f"WITH {O.TRACK}, a AS (SELECT {K3}, arg_min(g, (t, seq)) AS guess, arg_min(evse_status <> '', (t, seq)) AS hard, arg_min(NOT (retx_60s > 60 OR coalesce(link_gap > 3 AND phase <> 'idle', false)) AND rst_seen, (t, seq)) AS rst FROM (SELECT *, {O.SPEC} AS g FROM trk) WHERE g IS NOT NULL GROUP BY ALL) SELECT {K3}, {_RESOLVED} AS resolved FROM a")
def b14(s, d):
    a = D.first_alerts(D.spec_rules(tracked(s, d)), "Spec")
    family = F.when(F.col("sid") % 2 == 0, F.col("fault_guess"))
    return a.select(*KEYS, FC.resolve_family(family, F.col("reason")).alias("resolved"))


@query("b15_explanations", f"WITH {O.CONF}, a AS ({O.alerts('conf', O.CONFR, 'Conformance').replace('arg_min(g, (t, seq)) AS guess', 'arg_min(g, (t, seq)) AS guess, arg_min(ongoing_s >= 55, (t, seq)) AS slow')}) SELECT guess AS resolved_family, CASE guess WHEN 'EVSE_FAULT' THEN 'evse' WHEN 'ISOLATION_FAULT' THEN 'evse' WHEN 'EV_ERROR' THEN 'ev' WHEN 'SESSION_ABORT' THEN CASE WHEN setup THEN 'evse' ELSE 'unknown' END WHEN 'COMM_FREEZE' THEN CASE WHEN slow THEN 'shared' ELSE 'unknown' END ELSE 'unknown' END AS stop_party, count(*) AS n FROM (SELECT a.*, setup FROM a JOIN (SELECT {K3}, arg_min(comm_setup_s >= 20, (t, seq)) AS setup FROM (SELECT *, {O.CONFR} AS g FROM conf) WHERE g IS NOT NULL GROUP BY ALL) USING ({K3})) GROUP BY ALL")
def b15(s, d):
    a = alerts(s, d, ["Conformance"])
    return FC.explained(a, "fault_guess").where("known_family AND title IS NOT NULL").groupBy("resolved_family", "stop_party").agg(F.count("*").alias("n"))


_POLICY = "CASE seq % 5 WHEN 0 THEN 'off' WHEN 1 THEN ' Normative' WHEN 2 THEN 'empirical' WHEN 3 THEN 'both' END"


@query("b18_policy_arm", f"WITH {O.TEL}, p AS (SELECT kind = 'v2g' AS iso2, lower(trim(coalesce({_POLICY}, ''))) AS mode FROM tel) SELECT iso2, mode, CASE WHEN mode IN ('', 'off') THEN CASE WHEN iso2 THEN 'iso2' ELSE 'baseline' END WHEN mode = 'normative' THEN CASE WHEN iso2 THEN 'iso2normative' ELSE mode END WHEN mode = 'empirical' AND NOT iso2 THEN mode END AS arm, count(*) AS n FROM p GROUP BY ALL")
def b18(s, d):
    k = F.col("seq") % 5
    mode = F.when(k == 0, "off").when(k == 1, " Normative").when(k == 2, "empirical").when(k == 3, "both")
    rows = telemetry.fixture(s, d).select((F.col("kind") == "v2g").alias("iso2"), mode.alias("m"))
    return rows.select("iso2", F.lower(F.trim(F.coalesce("m", F.lit("")))).alias("mode"), S.research_arm(F.col("iso2"), F.col("m")).alias("arm")).groupBy("iso2", "mode", "arm").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- policies, lenses, models

_LAYERS = f"""ly AS (SELECT {K3}, t, seq, 0 AS layer, {O.SPEC} AS g FROM trk UNION ALL SELECT {K3}, t, seq, 1, {O.CONFR} FROM conf
  UNION ALL SELECT {K3}, t, seq, 2, CASE WHEN NOT v2g_seen AND ((match_pending AND match_pending_s >= 0.6) OR (awaiting AND awaiting_s >= 10)) THEN 'SLAC_FAILURE' END FROM mat)"""


@query("d15_policies", f"WITH {O.CONF}, {O.MATCH.replace(O.SES + ',', '', 1)}, {_LAYERS} SELECT p AS policy, {K3}, CAST(round(arg_min(t, (t, seq, layer)) * 1e6) AS BIGINT) AS t_us, arg_min(g, (t, seq, layer)) AS fault_guess FROM ly, (VALUES ('baseline', 0), ('iso15118-standard', 2)) x(p, top) WHERE g IS NOT NULL AND layer <= top GROUP BY ALL")
def d15(s, d):
    return D.detect_under_policies(X.matching(everything(s, d))).select("policy", *KEYS, *micros("t"), "fault_guess")


_REFLEX = """CASE WHEN resp_code <> '' THEN 'PROTOCOL_FAILED' WHEN evse_status <> '' THEN 'EVSE_FAULT' WHEN isolation = 'Fault' THEN 'ISOLATION_FAULT' WHEN ev_err <> '' THEN 'EV_ERROR' WHEN hit THEN 'SLAC_FAILURE'
  WHEN ongoing_s >= 60 THEN 'COMM_FREEZE' WHEN seq_gap_s >= 60 THEN 'COMM_FREEZE' WHEN comm_setup_s >= 20 THEN 'SESSION_ABORT' END"""


@query("d14_reflex_goals", f"WITH {O.CONF}, {O.MATCH.replace(O.SES + ',', '', 1)}, b AS (SELECT conf.*, NOT v2g_seen AND match_pending AND match_pending_s >= 10 AS hit FROM conf JOIN (SELECT seq, v2g_seen, match_pending, match_pending_s FROM mat) USING (seq)) SELECT {K3}, CAST(round(arg_min(t, (t, seq)) * 1e6) AS BIGINT) AS t_us, arg_min(g, (t, seq)) AS fault_guess FROM (SELECT *, {_REFLEX} AS g FROM b) WHERE g IS NOT NULL GROUP BY ALL")
def d14(s, d):
    return D.first_alerts(D.reflex_goals(X.matching(conformance(s, d))), "Reflex").select(*KEYS, *micros("t"), "fault_guess")


@query("d11_consensus")
def d11(s, d):
    rows = all_tools(s, d)
    rows = rows.withColumns(D.lens_posts(rows) | {f"{n}_sharp": w for n, w in D.lens_posts(rows, SF.FOCUS_GAIN).items()})
    return SF.consensus(rows, list(D.LENSES), sharpened=[f"{n}_sharp" for n in D.LENSES]).select(*KEYS, *micros("t", "confidence"), "reason")


_SERIES = {"slac_s": "slac", "handshake_s": "handshake", "cablecheck_s": "cablecheck", "precharge_s": "precharge"}
_OBSERVED = f"""ob AS (SELECT {K3}, min(t) AS t0, """ + ", ".join(f"arg_max(t - entered, (t, seq)) FILTER (turned AND was = '{p}' AND entered IS NOT NULL) AS {n}" for n, p in _SERIES.items()) + f""",
  avg(req_res_latency) AS mean_latency, avg(abs(v_ripple_z)) FILTER (phase = 'delivery' AND abs(v_ripple_z) > 0) AS mean_ripple, bool_or(msg = 'SessionStopRes') AS graceful FROM tv GROUP BY ALL),
oh AS (SELECT ob.*, graceful AND first_fault_t IS NULL AS healthy FROM ob JOIN lab USING ({K3})),
og AS (SELECT station, connector, series, x, d, a, healthy, sid, row_number() OVER (PARTITION BY station, connector, series ORDER BY t0, sid) AS k FROM oh, LATERAL (VALUES {", ".join(f"('{n}', CASE WHEN {n} > 0 THEN {n} END, {d}, {a})" if d else f"('{n}', {n}, NULL, {a})" for n, (d, a) in D.LEARNED.items())}) v(series, x, d, a)),
es AS (SELECT DISTINCT station, connector, series, 0::BIGINT AS k, NULL::DOUBLE AS m, NULL::DOUBLE AS v FROM og
  UNION ALL SELECT es.station, es.connector, es.series, es.k + 1, CASE WHEN NOT healthy OR x IS NULL THEN m WHEN m IS NULL THEN x ELSE m + a * (x - m) END, CASE WHEN NOT healthy OR x IS NULL THEN v WHEN m IS NULL THEN 0 ELSE (1 - a) * (v + a * (x - m) * (x - m)) END
  FROM es JOIN og ON es.station = og.station AND es.connector = og.connector AND es.series = og.series AND og.k = es.k + 1)"""


def _expect_sql(name: str) -> str:
    return f"CAST(round(max(CASE WHEN og.k > 3 AND m IS NOT NULL THEN greatest(m + 3 * sqrt(v) + 0.25 * abs(m), d / 2) ELSE d END) FILTER (og.series = '{name}') * 1e3) AS BIGINT) AS {name}_m"


def observed_sessions(s, d) -> tuple[DataFrame, DataFrame]:
    """All features of the rows, as a table, and which sessions are free of faults."""
    rows = stored(sessions(s, d), "sessions")
    healthy = G.label_sessions(rows).select(*KEYS, F.col("first_fault_t").isNull().alias("healthy"))
    return stored(X.matching(X.conformance(X.smoothed(X.tracked(rows)))), "features"), healthy


@query("d13_station_expectations", f"WITH RECURSIVE {O.FULL.replace('RECURSIVE', '')}, {_TURNS}, {O.LABELS}, {_OBSERVED} SELECT {', '.join('og.' + k.strip() for k in K3.split(','))}, {', '.join(map(_expect_sql, D.LEARNED))} FROM og JOIN es ON es.station = og.station AND es.connector = og.connector AND es.series = og.series AND es.k = og.k - 1 GROUP BY ALL")
def d13_expectations(s, d):
    rows, healthy = observed_sessions(s, d)
    observed = X.session_observations(rows).join(rows.groupBy(*KEYS).agg(F.min("t").alias("t_start")), KEYS).join(healthy, KEYS)
    out = D.station_expectations(observed.withColumn("healthy", F.col("healthy") & F.col("graceful")))
    return out.select(*KEYS, *[F.round(F.col(f"expected_{n}") * 1e3).cast("bigint").alias(f"{n}_m") for n in D.LEARNED])


@query("d12_investigations")
def d12(s, d):
    return SF.investigations(SF.with_expectations(*observed_sessions(s, d))).select(*KEYS, *micros("t"), "reason")


def busy_features(s, d) -> tuple[DataFrame, DataFrame]:
    """All features of long sessions, as a table, and the sessions whose station states no faults: those that models learn from."""
    rows = stored(X.matching(X.conformance(X.smoothed(X.tracked(stored(busy_sessions(s, d), "sessions"))))), "features")
    return rows, rows.select(*KEYS).distinct().where(F.substring("station", 3, 10).cast("int") % 2 == 0)


@query("d12_model_evidence")
def d12_models(s, d):
    """Investigations of long sessions that also weigh reconstruction errors and forecast surprise."""
    rows, clean = busy_features(s, d)
    windows = stored(M.step_windows(X.feature_vector(rows)), "windows")
    anomaly = M.anomaly_z(windows, M.fit_reconstruction(windows, clean))
    lags = stored(M.delivery_lags(rows.withColumn("i_dev", F.coalesce("i_dev", F.lit(0.0)))), "lags")
    ready = SF.with_expectations(rows, clean.withColumn("healthy", F.lit(True)), anomaly, M.surprise(lags, M.fit_forecast(lags, clean)))
    return SF.investigations(ready).select(*KEYS, *micros("t"), "reason")


def steps(s, d) -> DataFrame:
    return T.step_labels(X.feature_vector(smoothed(s, d)), labels(s, d))


@query("d6_risk")
def d6(s, d):
    rows = D.cadence(steps(s, d))
    return M.risk_scores(rows, M.fit_risk(rows, trees=10, depth=4)).select(*KEYS, "seq", "y", "risk")


@query("d7_isolation_forest")
def d7(s, d):
    rows = steps(s, d).select(*KEYS, "seq", "vector", "first_fault_t")
    forest = SF.isolation_forest(rows.where("first_fault_t IS NULL"))
    return SF.isolation_scores(rows, forest).select(*KEYS, "seq", "anomaly")


@query("d16_reconstruction")
def d16(s, d):
    rows, clean = busy_features(s, d)
    windows = stored(M.step_windows(X.feature_vector(rows)), "windows")
    return M.anomaly_z(windows, M.fit_reconstruction(windows, clean)).select(*KEYS, "seq", "anomaly")


@query("d17_forecast_surprise")
def d17(s, d):
    rows, clean = busy_features(s, d)
    lags = stored(M.delivery_lags(rows.withColumn("i_dev", F.coalesce("i_dev", F.lit(0.0)))), "lags")
    return M.surprise(lags, M.fit_forecast(lags, clean)).select(*KEYS, "seq", "surprise")


# ---------------------------------------------------------------- captures

_STOP = f"""mk AS (SELECT {K3}, bool_or(msg = 'SessionStopReq') AS asked, bool_or(kind = 'v2g') AS talks, bool_or(kind = 'hpav') AS linked, bool_or(msg = 'RST') AS rst,
  arg_min(CASE WHEN evse_status <> '' THEN evse_status ELSE notification END, (t, seq)) FILTER (notification = 'StopCharging' OR evse_status <> '') AS ch,
  arg_min(CASE WHEN ev_err <> '' THEN ev_err ELSE 'ChargingComplete=TRUE' END, (t, seq)) FILTER (charge_complete = 'true' OR ev_err <> '') AS ve, arg_min(ev_err <> '', (t, seq)) FILTER (charge_complete = 'true' OR ev_err <> '') AS hard,
  arg_min(msg || ':' || resp_code, (t, seq)) FILTER (resp_code <> '') AS fa FROM ses GROUP BY ALL),
st AS (SELECT mk.*, coalesce(a.guess, '') AS family, coalesce(a.slow, false) AS slow, coalesce(a.setup, false) AS nosetup FROM mk LEFT JOIN (SELECT {K3}, arg_min(g, (t, seq)) AS guess, arg_min(ongoing_s >= 55, (t, seq)) AS slow, arg_min(comm_setup_s >= 20 AND ongoing_s < 55 AND seq_gap_s < 60, (t, seq)) AS setup, arg_min(cablecheck_open AND cablecheck_s >= 40, (t, seq)) AS cable FROM (SELECT *, {O.CONFR} AS g FROM conf) WHERE g IS NOT NULL GROUP BY ALL) a USING ({K3})),
cb AS (SELECT {K3}, arg_min(NOT (ongoing_s >= 55 OR seq_gap_s >= 60 OR comm_setup_s >= 20) AND cablecheck_open AND cablecheck_s >= 40, (t, seq)) AS cable FROM (SELECT *, {O.CONFR} AS g FROM conf) WHERE g IS NOT NULL GROUP BY ALL)"""
_BY = """CASE WHEN family = 'SLAC_FAILURE' OR (NOT talks AND linked) THEN 'not_applicable' WHEN ch IS NOT NULL THEN 'charger' WHEN family = 'ISOLATION_FAULT' THEN 'charger' WHEN ve IS NOT NULL THEN 'vehicle'
  WHEN family = 'PROTOCOL_FAILED' AND fa IS NOT NULL THEN CASE WHEN fa LIKE 'SessionStopRes%' AND asked THEN 'vehicle' ELSE 'charger' END WHEN family = 'SESSION_ABORT' AND nosetup THEN 'charger'
  WHEN family = 'COMM_FREEZE' AND (slow OR coalesce(cable, false)) THEN 'charger' WHEN rst THEN 'unknown' WHEN asked THEN 'vehicle' ELSE 'unknown' END"""
_SURE = """CASE WHEN family = 'SLAC_FAILURE' OR (NOT talks AND linked) OR ch IS NOT NULL OR family = 'ISOLATION_FAULT' THEN 'high' WHEN ve IS NOT NULL THEN CASE WHEN hard THEN 'high' ELSE 'medium' END
  WHEN family = 'PROTOCOL_FAILED' AND fa IS NOT NULL THEN 'high' WHEN family = 'SESSION_ABORT' AND nosetup THEN 'medium' WHEN family = 'COMM_FREEZE' AND (slow OR coalesce(cable, false)) THEN 'medium' WHEN rst THEN 'low' WHEN asked THEN 'medium' ELSE 'low' END"""


@query("d18_stop_attribution", f"WITH {O.CONF}, {_STOP} SELECT {K3}, {_BY} AS triggered_by, {_SURE} AS confidence, CASE WHEN asked AND NOT (family = 'SLAC_FAILURE' OR (NOT talks AND linked)) THEN 'vehicle' END AS request_sender, CASE WHEN family = 'SLAC_FAILURE' OR (NOT talks AND linked) THEN '' ELSE coalesce(ch, '') END AS marker FROM st LEFT JOIN cb USING ({K3})")
def d18(s, d):
    a = alerts(s, d, ["Conformance"])
    found = C.stop_attribution(sessions(s, d), a)
    marker = F.when((F.col("triggered_by") == "charger") & F.col("evidence").contains(" before or during "), F.regexp_extract("evidence", "^EVSE reported (.*) before", 1))
    return found.select(*KEYS, "triggered_by", "confidence", "request_sender", F.coalesce(marker, F.lit("")).alias("marker"))


_CAP = f"""ss AS (SELECT {K3}, min(t) AS t0, max(t) AS t1, count(*) AS n, coalesce(bool_or(msg = 'SessionStopRes' AND resp_code = ''), false) AS graceful, arg_min(msg, (t, seq)) FILTER (kind = 'v2g') AS fm FROM ses GROUP BY ALL),
sr AS (SELECT ss.*, a.t AS alt, a.guess, row_number() OVER (PARTITION BY ss.station ORDER BY t0, ss.station, ss.connector, ss.sid) AS place FROM ss LEFT JOIN al a ON a.detector = 'Conformance' AND a.station = ss.station AND a.connector = ss.connector AND a.sid = ss.sid),
cp AS (SELECT station, count(*) AS n_sessions, count(*) FILTER (graceful) AS n_complete, count(alt) AS n_alerted, arg_min(guess, (alt, place)) FILTER (alt IS NOT NULL) AS fam, arg_min(fm, place) FILTER (place = 1) AS f1 FROM sr GROUP BY ALL)"""


@query("d19_capture_verdicts", f"WITH {O.SCORED}, {_CAP} SELECT t.station, CASE WHEN n_alerted > 0 THEN 'fault_detected' WHEN coalesce(n_sessions, 0) = 0 OR n_complete < n_sessions THEN 'inconclusive' ELSE 'no_fault_detected' END AS status, fam AS fault_family, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_complete, 0) AS n_complete, concat_ws(',', CASE WHEN f1 NOT IN ('supportedAppProtocolReq', 'SessionSetupReq') THEN 'capture_starts_mid_session' END, CASE WHEN n_sessions IS NULL THEN 'no_sessions' END, CASE WHEN n_complete < n_sessions THEN 'incomplete_session' END, CASE WHEN n_sessions > 500 THEN 'session_details_truncated' END, CASE WHEN n_alerted = 0 AND n_sessions > 0 AND n_complete = n_sessions THEN 'no_alert_not_health_proof' END) AS warnings FROM (SELECT DISTINCT station FROM tel) t LEFT JOIN cp USING (station)")
def d19(s, d):
    captures = telemetry.fixture(s, d).groupBy("station").agg(F.count("*").alias("n_events"))
    found = C.capture_sessions(sessions(s, d), alerts(s, d, ["Conformance"]), "station")
    return C.capture_verdicts(captures, found, "station").select("station", "status", "fault_family", "n_sessions", "n_complete", F.concat_ws(",", "warnings").alias("warnings"))


_STAGE10 = "CASE left(msg, len(msg) - 3) " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(C.CHARGING)) + " END"
_NAME10 = "CASE reached " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(C.CHARGING)) + " ELSE '?' END"
_OBS = f"""ob AS (SELECT {K3}, max(t) AS te, min(t) FILTER (kind = 'v2g') AS v0, max(t) FILTER (kind = 'v2g') AS v1, arg_max(left(msg, len(msg) - 3), (t, seq)) FILTER (kind = 'v2g') AS lb, max(CASE WHEN kind = 'v2g' THEN {_STAGE10} END) AS reached, coalesce(bool_or(msg LIKE 'CurrentDemand%'), false) AS cd,
  count(*) FILTER (msg LIKE 'CableCheck%' AND isolation <> '') AS ni, count(*) FILTER (msg LIKE 'CableCheck%' AND isolation NOT IN ('', 'Valid')) AS bi, min(t) FILTER (msg LIKE 'CableCheck%') AS c0, max(t) FILTER (msg LIKE 'CableCheck%') AS c1, count(*) FILTER (msg = 'CableCheckReq') AS nc,
  arg_max(ev_target_v, (t, seq)) FILTER (msg LIKE 'PreCharge%' AND ev_target_v <> 0) AS tg, arg_max(evse_v, (t, seq)) FILTER (msg LIKE 'PreCharge%' AND evse_v <> 0) AS vo, min(t) FILTER (kind = 'hpav' AND regexp_matches(msg, 'SLAC|ATTEN_CHAR')) AS s0 FROM ses GROUP BY ALL HAVING count(*) FILTER (kind = 'v2g') > 0),
af AS (SELECT {K3}, count(*) FILTER (t > v1) AS after FROM ses JOIN ob USING ({K3}) GROUP BY ALL)"""


@query("d20_observations", f"WITH {O.SES}, {_OBS} SELECT {K3}, 'no_current_demand' AS code, {_NAME10} AS args FROM ob WHERE NOT cd UNION ALL SELECT {K3}, 'silent_after', lb || ',' || printf('%.1f', round(te - v1, 1)) || ',' || after FROM ob JOIN af USING ({K3}) WHERE te - v1 >= 10 AND lb <> 'SessionStop' UNION ALL SELECT {K3}, 'isolation_invalid', bi || ',' || ni FROM ob WHERE bi > 0 UNION ALL SELECT {K3}, 'cablecheck_long', printf('%.1f', round(c1 - c0, 1)) || ',' || nc FROM ob WHERE c1 - c0 > 10 UNION ALL SELECT {K3}, 'precharge_short', printf('%.1f', round(vo, 1)) || ',' || printf('%.1f', round(tg, 1)) || ',' || printf('%.1f', round(tg - vo, 1)) FROM ob WHERE tg - vo > 5 UNION ALL SELECT {K3}, 'slac_slow', printf('%.1f', round(v0 - s0, 1)) FROM ob WHERE v0 - s0 > 20")
def d20(s, d):
    return C.observations(sessions(s, d)).select(*KEYS, "code", F.concat_ws(",", "args").alias("args"))


# ---------------------------------------------------------------- re-scoring and comparisons


def legacy(s, d) -> DataFrame:
    return G.label_sessions(sessions(s, d), "legacy")


def _board(source: str, keys: str = "detector") -> str:
    return f"g AS (SELECT {keys}, {_METRICS} FROM {source} GROUP BY {keys}), h AS (SELECT *, {_RATES} FROM g)"


@query("r20_rescored", f"WITH {O.SCORED_L}, {_board('sc_l')} SELECT detector, {_OUT} FROM h")
def r20(s, d):
    return board(R.rescored(alerts(s, d), legacy(s, d), _names(s)), "detector")


@query("r21_without_questioned", f"WITH {O.SCORED_L}, q AS (SELECT {K3} FROM lab_l l WHERE list_contains(families, 'SESSION_ABORT') AND ({K3}) NOT IN (SELECT ({K3}) FROM ff WHERE family = 'SESSION_ABORT')), x AS (SELECT * FROM sc ANTI JOIN q USING ({K3})), {_board('x')} SELECT detector, {_OUT} FROM h")
def r21(s, d):
    aborts = lambda df: df.where(F.array_contains("faults.family", "SESSION_ABORT")).select(*KEYS)
    questioned = aborts(legacy(s, d)).join(aborts(labels(s, d)), KEYS, "left_anti")
    return board(R.without(outcomes(s, d), questioned), "detector")


def boards(s, d) -> DataFrame:
    old = R.rescored(alerts(s, d), legacy(s, d), _names(s)).withColumn("arm", F.lit("legacy"))
    return old.unionByName(R.scored(outcomes(s, d), "detector").withColumn("arm", F.lit("strict")))


_BOARDS = "bo AS (SELECT 'legacy' AS arm, * FROM sc_l UNION ALL BY NAME SELECT 'strict' AS arm, * FROM sc)"
_SCORE = "50 * recall + 30 * (1 - far) + 20 * earliness"


@query("r17_arms", f"WITH {O.SCORED_L}, {_BOARDS}, {_board('bo', 'arm, detector')} SELECT a.arm, a.detector, CAST(round((({_SCORE.replace('recall', 'a.recall').replace('far', 'a.far').replace('earliness', 'a.earliness')}) - ({_SCORE.replace('recall', 'b.recall').replace('far', 'b.far').replace('earliness', 'b.earliness')})) * 1e6) AS BIGINT) AS score_delta_us, CAST(round((a.recall - b.recall) * 1e6) AS BIGINT) AS recall_delta_us FROM h a JOIN h b ON a.detector = b.detector AND b.arm = 'legacy'")
def r17(s, d):
    return R.arms(boards(s, d), "legacy").select("arm", "detector", *micros("score_delta", "recall_delta"))


@query("r29_generations", f"WITH {O.SCORED_L}, {_BOARDS}, {_board('bo', 'arm, detector')} SELECT detector, 'baseline' AS arm, CAST(round(max(recall) FILTER (arm = 'legacy') * 1e6) AS BIGINT) AS legacy_us, CAST(round(max(recall) FILTER (arm = 'strict') * 1e6) AS BIGINT) AS strict_us, CAST(round((max(recall) FILTER (arm = 'strict') - max(recall) FILTER (arm = 'legacy')) * 1e6) AS BIGINT) AS change_us FROM h GROUP BY detector")
def r29(s, d):
    b = boards(s, d).withColumnRenamed("arm", "generation").withColumn("arm", F.lit("baseline"))
    return R.generations(b, ["legacy", "strict"], "recall").select("detector", "arm", *micros("legacy", "strict", "change"))


@query("r30_grid_match", f"WITH {O.SCORED} SELECT g AS grid, CAST(m AS BIGINT) AS matches, r AS relation FROM (VALUES ('own', 2, 'same'), ('other', 0, 'different')) x(g, m, r)")
def r30(s, d):
    b = R.scored(outcomes(s, d), "detector").select("detector", "score", (100 * F.col("recall")).alias("recall"), (100 * F.col("far")).alias("far"))
    shown = b.select("detector", *[F.round(c, 1).alias(c) for c in ("score", "recall", "far")])
    grids = shown.withColumn("grid", F.lit("own")).unionByName(shown.withColumn("score", F.col("score") + 0.1).withColumn("grid", F.lit("other")))
    return R.matched_grid(b, grids, 2)


@query("r18_run_diff", f"WITH {O.SCORED_L}, o AS (SELECT station, connector, CAST(round(t_start) AS BIGINT) AS start, families FROM lab_l WHERE sid % 7 <> 0), n AS (SELECT station, connector, CAST(round(t_start) AS BIGINT) AS start, families FROM lab WHERE sid % 5 <> 0) SELECT station, connector, start, CASE WHEN n.families IS NULL THEN 'only_old' WHEN o.families IS NULL THEN 'only_new' WHEN o.families = n.families THEN 'common' ELSE 'relabelled' END AS change FROM o FULL JOIN n USING (station, connector, start)")
def r18(s, d):
    run = lambda df, drop: df.where(F.col("sid") % drop != 0).select("station", "connector", F.round("t_start").cast("bigint").alias("start"), F.array_sort("faults.family").alias("families"))
    return R.run_diff(run(legacy(s, d), 7), run(labels(s, d), 5))


@query("r19_flips", f"WITH {O.SCORED_L}, j AS (SELECT detector, a.outcome AS a, b.outcome AS b FROM sc_l a JOIN sc b USING ({K3}, detector)) SELECT detector, CASE WHEN a = 'tp' AND b = 'tp' THEN 'kept' WHEN b = 'tp' THEN 'gained' WHEN a = 'tp' THEN 'lost' WHEN a = 'fp' AND b = 'quiet' THEN 'fixed_fp' WHEN a = 'quiet' AND b = 'fp' THEN 'new_fp' WHEN a = 'quiet' THEN 'quiet' ELSE 'other' END AS flip, count(*) AS n FROM j GROUP BY ALL")
def r19(s, d):
    return R.flips(R.outcomes(legacy(s, d), alerts(s, d), _names(s)), outcomes(s, d)).select("detector", "flip", "n")


@query("r28_agreement", f"WITH {O.SCORED}, p AS (SELECT {K3}, min(t) AS t FROM al GROUP BY ALL) SELECT 'Spec' AS detector, count(*) AS n, count(*) FILTER (p.t IS NOT DISTINCT FROM a.t) AS same FROM p FULL JOIN (SELECT * FROM al WHERE detector = 'Spec') a USING ({K3})")
def r28(s, d):
    spec = alerts(s, d, ["Spec"])
    p = R.projected(spec, alerts(s, d, ["Conformance"]).select(*KEYS, "t"), ["Spec"])
    return R.agreement(p, spec).select("detector", "n", "same")


@query("r5_by_source", f"WITH {O.SCORED}, x AS (SELECT *, CASE CAST(substr(station, 3) AS INT) % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'v2g2024' ELSE 'v2g2025' END AS source FROM sc), {_board('x', 'detector, source')} SELECT detector, " + ", ".join(f"CAST(round(max({m}) FILTER (source = '{n}') * 1e6) AS BIGINT) AS {m}_{n}_us" for n in ("main", "v2g2024", "v2g2025") for m in ("recall", "far")) + ", CAST(round((max(recall) - min(recall)) * 1e6) AS BIGINT) AS spread_us FROM h GROUP BY detector")
def r5_source(s, d):
    names = ("main", "v2g2024", "v2g2025")
    stations = telemetry.fixture(s, d).select("station").distinct()
    place = F.substring("station", 3, 10).cast("int") % 3
    sources = stations.withColumn("source", F.element_at(F.array(*map(F.lit, names)), place + 1))
    return R.by_source(outcomes(s, d), sources, *names).select("detector", *micros(*[f"{m}_{n}" for n in names for m in ("recall", "far")], "spread"))


@query("r8_top_evidence", f"WITH {O.TRACK}, {O.LABELS}, e AS (SELECT station, family, count(*) AS n FROM mark GROUP BY ALL) SELECT station, family, CAST(sum(n) AS BIGINT) AS n FROM (SELECT station, 'PROTOCOL_FAILED' AS family, msg || ':' || resp_code AS d, count(*) AS n, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, msg || ':' || resp_code) AS p FROM ses WHERE resp_code <> '' GROUP BY station, msg || ':' || resp_code UNION ALL SELECT station, 'EVSE_FAULT', msg || ':' || evse_status, count(*), row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, msg || ':' || evse_status) FROM ses WHERE evse_status <> '' GROUP BY station, msg || ':' || evse_status UNION ALL SELECT station, 'ISOLATION_FAULT', msg || ':IsolationFault', count(*), row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, msg) FROM ses WHERE isolation = 'Fault' GROUP BY station, msg UNION ALL SELECT station, 'EV_ERROR', msg || ':' || ev_err, count(*), row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, msg || ':' || ev_err) FROM ses WHERE ev_err <> '' GROUP BY station, msg || ':' || ev_err) WHERE p <= 3 GROUP BY station, family")
def r8_top(s, d):
    return R.top_evidence(G.marker_faults(sessions(s, d))).groupBy("station", "family").agg(F.sum("n").alias("n"))


@query("r13_totals", f"WITH {O.SES}, {O.LABELS}, st AS (SELECT station, count(*) AS sessions, count(first_fault_t) AS f FROM lab GROUP BY 1) SELECT count(*) FILTER (contains(station, '1')) AS stations, CAST(coalesce(sum(sessions) FILTER (contains(station, '1')), 0) AS BIGINT) AS sessions, CAST(coalesce(sum(f) FILTER (contains(station, '1')), 0) AS BIGINT) AS n_faulty, count(*) FILTER (NOT contains(station, '1')) AS hidden FROM st")
def r13_totals(s, d):
    st = labels(s, d).groupBy("station").agg(F.count("*").alias("sessions"), F.count("first_fault_t").alias("n_faulty")).withColumn("split", F.lit("test"))
    return R.totals(st, "test", "1")


@query("r9_gates_fire", f"WITH {O.SCORED} SELECT detector, rule FROM (SELECT DISTINCT detector FROM sc), (VALUES ('outcomes of faulty sessions'), ('recall'), ('families'), ('stations')) x(rule)")
def r9_fires(s, d):
    """The gates on a board whose true positives are one too many: each gate that reads them must speak."""
    o = outcomes(s, d)
    return R.violations(R.scored(o, "detector").withColumn("tp", F.col("tp") + 1), R.recall_by_family(o), R.scored(o, "station", "detector"))


@query("r23_corroborated", f"WITH {O.SCORED}, m AS (SELECT {K3}, max(msg_timeout_ratio) >= 1 OR max(seq_gap_s) >= 60 OR max(ongoing_s) >= 60 OR max(dialog) > 1 OR bool_or(msg = 'RST') AS c FROM conf GROUP BY ALL) SELECT detector, c AS corroborated, count(*) AS n, count(*) FILTER (outcome = 'tp') AS detected FROM sc JOIN m USING ({K3}) WHERE first_fault_family = 'SESSION_ABORT' GROUP BY ALL")
def r23b(s, d):
    return R.corroborated_detection(R.abort_audit(conformance(s, d), labels(s, d)), outcomes(s, d))


@query("r24_span_evidence", f"""WITH {O.SCORED}, mx AS (SELECT {K3}, max(seq_gap_s) AS seq_gap_s, max(ongoing_s) AS ongoing_s, max(cablecheck_s) AS cablecheck_s, max(comm_setup_s) AS comm_setup_s FROM conf GROUP BY ALL),
lg AS (SELECT first_fault_t IS NOT NULL AS faulty, timer, x, lim FROM mx JOIN lab USING ({K3}), LATERAL (VALUES ('seq_gap_s', seq_gap_s, 60), ('ongoing_s', ongoing_s, 60), ('cablecheck_s', cablecheck_s, 40), ('comm_setup_s', comm_setup_s, 20)) v(timer, x, lim)),
g AS (SELECT timer, faulty, count(*) AS n, list_sort(list(x)) AS ls, count(*) FILTER (x >= lim) / count(*) AS past FROM lg GROUP BY ALL)
SELECT timer, faulty, n, CAST(round(ls[CAST(round_even((n - 1) * 0.5, 0) AS INT) + 1] * 1e6) AS BIGINT) AS p50_us, CAST(round(ls[CAST(round_even((n - 1) * 0.99, 0) AS INT) + 1] * 1e6) AS BIGINT) AS p99_us, CAST(round(past * 1e6) AS BIGINT) AS past_us,
  CASE WHEN coalesce(max(past) FILTER (faulty) OVER (PARTITION BY timer), 0) >= 2 * coalesce(max(past) FILTER (NOT faulty) OVER (PARTITION BY timer), 0) THEN 'separates' ELSE 'flat' END AS verdict FROM g""")
def r24_spans(s, d):
    return R.span_evidence(conformance(s, d), labels(s, d)).select("timer", "faulty", "n", *micros("p50", "p99", "past"), "verdict")


@query("r22_anchor_moves", f"WITH {O.SCORED_L} SELECT family, count(*) AS n, count(*) FILTER (abs(b - a) > 0.5) AS moved, CAST(round(min(b - a) * 1e6) AS BIGINT) AS least_us FROM (SELECT o.first_fault_family AS family, o.first_fault_t AS a, n.first_fault_t AS b FROM lab_l o JOIN lab n USING ({K3}) WHERE o.first_fault_family = n.first_fault_family) GROUP BY ALL")
def r22_moves(s, d):
    return R.anchor_moves(legacy(s, d), labels(s, d)).select("family", "n", "moved", F.round(F.col("least_s") * 1e6).cast("bigint").alias("least_us"))


# ---------------------------------------------------------------- the reviewed profile


def reviewed_parts(s, d) -> tuple[DataFrame, DataFrame]:
    rows = stored(sessions(s, d), "sessions")
    return rows, stored(G.is_session(G.session_facts(rows)), "facts")


def _first(df: DataFrame) -> DataFrame:
    return G.first_faults(df).select(*KEYS, "family", *micros("t"))


_NUMBER = "CAST(substr(station, 3) AS INT) // 10"
_DENSE_SES = O.SES.replace(O.TEL, O.TEL.replace("\ntel AS (", "\ntel0 AS (") + f""", tel AS (SELECT * REPLACE ('ST' || lpad(CAST({_NUMBER} AS VARCHAR), 4, '0') AS station, t / 40 AS t, CASE WHEN msg = 'PreChargeRes' THEN evse_v + 40 ELSE ev_target_v END AS ev_target_v,
  {", ".join(f"CASE WHEN {_NUMBER} % 2 = 1 THEN {c} ELSE '' END AS {c}" for c in ("resp_code", "evse_status", "isolation", "ev_err"))}) FROM tel0 WHERE NOT (kind = 'v2g' AND msg LIKE 'SessionStop%'))""")


def _proven(name: str, least: int, gap: float, source: str) -> str:
    """Candidates of ``source`` (session, t, family, a, b) whose interval has enough rows and no wider gap."""
    return f"""{name}_c AS (SELECT *, row_number() OVER () AS c FROM ({source}) WHERE b > a),
{name}_g AS (SELECT c.*, s.t AS at_, s.t - coalesce(lag(s.t) OVER (PARTITION BY c ORDER BY s.t), a) AS gap FROM {name}_c c JOIN (SELECT {K3}, t FROM ses) s USING ({K3}) WHERE s.t BETWEEN a AND b),
{name} AS (SELECT {K3}, t, family FROM {name}_g GROUP BY c, {K3}, t, family, a, b HAVING count(*) >= {least} AND max(gap) <= {gap} AND b - max(at_) <= {gap})""".replace("c.*, s.t AS at_", f"{', '.join('c.' + k.strip() for k in K3.split(','))}, c.t, c.family, c.a, c.b, c.c, s.t AS at_")


_V = f"""v0 AS (SELECT s.*, t_end, CASE WHEN msg LIKE '%Req' THEN 'Req' WHEN msg LIKE '%Res' THEN 'Res' ELSE '' END AS x, regexp_replace(msg, '(Req|Res)$', '') AS bs FROM ses s JOIN (SELECT {K3}, t_end FROM fct) USING ({K3}) WHERE kind = 'v2g'),
lim AS (SELECT left(m, len(m) - 3) AS bs, l AS lim, greatest(2 * l, 1.5) AS margin FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in K.MSG_TIMEOUT_S.items())}) x(m, l)),
v1 AS (SELECT *, CASE x WHEN 'Req' THEN t WHEN 'Res' THEN -1 END AS st, CASE x WHEN 'Req' THEN -1 WHEN 'Res' THEN t END AS sr, bs IN ('CableCheck', 'ChargeParameterDiscovery') AND x = 'Res' AS own FROM v0 LEFT JOIN lim USING (bs)),
v2 AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY {K3}, bs {O.O} {O.B}) AS before, last_value(st IGNORE NULLS) OVER (PARTITION BY {K3}, bs {O.O} ROWS UNBOUNDED PRECEDING) AS open_, last_value(sr IGNORE NULLS) OVER ({O.P} {O.O} {O.B}) AS since,
  count(*) FILTER (own AND evse_processing = 'Finished') OVER (PARTITION BY {K3}, bs {O.O} ROWS UNBOUNDED PRECEDING) AS ends FROM v1),
v3 AS (SELECT *, ends - CASE WHEN own AND evse_processing = 'Finished' THEN 1 ELSE 0 END AS wait FROM v2),
v AS (SELECT *, min(t) FILTER (own AND evse_processing = 'Ongoing') OVER (PARTITION BY {K3}, bs, wait {O.O} ROWS UNBOUNDED PRECEDING) AS o FROM v3),
tl AS (SELECT {K3}, bs, t_end, arg_max(open_, (t, seq)) AS open_, any_value(lim) AS lim, any_value(margin) AS margin, max(ends) AS e, arg_max(coalesce(o, -1), (t, seq)) FILTER (own) AS o, arg_max(wait, (t, seq)) FILTER (own) AS wait FROM v WHERE x <> '' GROUP BY ALL),
en AS (SELECT {K3}, t_end, arg_max(x, (t, seq)) AS x, arg_max(t, (t, seq)) AS l FROM v WHERE x <> '' GROUP BY ALL),
{_proven("tp1", 10, 1.0, f"SELECT {K3}, before + lim AS t, 'COMM_FREEZE' AS family, before AS a, t AS b FROM v WHERE x = 'Res' AND before >= 0 AND t - before >= margin UNION ALL SELECT {K3}, open_ + lim, 'COMM_FREEZE', open_ + lim, least(t_end, open_ + lim + 10) FROM tl WHERE open_ >= 0 AND t_end - open_ >= margin")},
{_proven("tp2", 100, 2.0, f"SELECT {K3}, since + 60 AS t, 'COMM_FREEZE' AS family, since AS a, since + 60 AS b FROM v WHERE x = 'Req' AND msg NOT IN ('supportedAppProtocolReq', 'SessionSetupReq') AND since >= 0 AND t - since >= 60 UNION ALL SELECT {K3}, l + 60, 'COMM_FREEZE', l, l + 60 FROM en WHERE x = 'Res' AND t_end - l >= 60")},
{_proven("tp3", 20, 5.0, f"SELECT {K3}, o + 60 AS t, 'EVSE_PROCESSING_STALL' AS family, o AS a, o + 60 AS b FROM v WHERE own AND evse_processing = 'Finished' AND t - o >= 60 UNION ALL SELECT {K3}, o + 60, 'EVSE_PROCESSING_STALL', o, o + 60 FROM tl WHERE wait = e AND o >= 0 AND t_end - o >= 60")},
tm AS (FROM tp1 UNION ALL FROM tp2 UNION ALL FROM tp3)"""
_FIRST = f"SELECT {K3}, family, CAST(round(min(t) * 1e6) AS BIGINT) AS t_us FROM"
_PRE = f"""dq AS (SELECT DISTINCT {K3} FROM ses WHERE kind = 'v2g' AND resp_code = '' AND (evse_v NOT BETWEEN 0 AND 1000 OR ev_target_v NOT BETWEEN 0 AND 1000 OR ev_max_v NOT BETWEEN 0 AND 1000 OR evse_max_v NOT BETWEEN 0 AND 1000 OR soc NOT BETWEEN 0 AND 100)),
pa AS (SELECT {K3}, min(t) AS a FROM ses WHERE msg = 'PreChargeReq' GROUP BY ALL),
pe AS (SELECT {K3}, a, a + 10 AS b FROM ses JOIN pa USING ({K3}) WHERE kind = 'v2g' GROUP BY ALL HAVING coalesce(min(t) FILTER (t > a AND msg = 'PowerDeliveryReq'), max(t) FILTER (t >= a AND msg LIKE 'PreCharge%')) > a + 10),
pm AS (SELECT {K3}, a, b, count(*) AS n, arg_min(abs(ev_target_v - evse_v), (t, seq)) AS f, arg_max(abs(ev_target_v - evse_v), (t, seq)) AS l FROM ses JOIN pe USING ({K3}) WHERE kind = 'v2g' AND t BETWEEN a AND b AND ev_target_v - evse_v IS NOT NULL GROUP BY ALL),
{_proven("pf", 10, 2.0, f"SELECT {K3}, b AS t, 'PRECHARGE_FAULT' AS family, a, b FROM pm ANTI JOIN dq USING ({K3}) WHERE n >= 2 AND l > 20 AND l >= 0.5 * greatest(f, 1.0)")}"""


def dense_parts(s, d) -> tuple[DataFrame, DataFrame]:
    rows = stored(dense_sessions(s, d), "sessions")
    return rows, stored(G.is_session(G.session_facts(rows)), "facts")


@query("g14_reviewed_timers", f"WITH {O.SES}, {O.FACTS}, {_V} {_FIRST} tm GROUP BY ALL")
def g14(s, d):
    return _first(V.timer_faults(*reviewed_parts(s, d)))


@query("g14_dense_timers", f"WITH {_DENSE_SES}, {O.FACTS}, {_V} {_FIRST} tm GROUP BY ALL")
def g14_dense(s, d):
    return _first(V.timer_faults(*dense_parts(s, d)))


@query("g15_reviewed_markers", f"WITH {O.SES}, {O.FACTS}, v AS (SELECT s.*, first_cd FROM ses s JOIN fct USING ({K3}) WHERE kind = 'v2g'), f AS (SELECT {K3}, t, 'PROTOCOL_FAILED' AS family FROM v WHERE resp_code <> '' UNION ALL SELECT {K3}, t, 'EVSE_FAULT' FROM v WHERE resp_code = '' AND evse_status <> '' UNION ALL SELECT {K3}, t, 'ISOLATION_FAULT' FROM v WHERE resp_code = '' AND isolation = 'Fault' UNION ALL SELECT {K3}, t, 'EV_ERROR' FROM v WHERE resp_code = '' AND ev_err <> '') SELECT {K3}, family, CAST(round(min(t) * 1e6) AS BIGINT) AS t_us FROM f GROUP BY ALL")
def g15(s, d):
    return _first(V.marker_faults(*reviewed_parts(s, d)))


@query("g16_reviewed_precharge", f"WITH {O.SES}, {O.FACTS}, {_PRE} {_FIRST} pf GROUP BY ALL")
def g16(s, d):
    rows, facts = reviewed_parts(s, d)
    return _first(V.precharge_faults(rows, facts, G.decode_quality(rows)))


@query("g16_dense_precharge", f"WITH {_DENSE_SES}, {O.FACTS}, {_PRE} {_FIRST} pf GROUP BY ALL")
def g16_dense(s, d):
    rows, facts = dense_parts(s, d)
    return _first(V.precharge_faults(rows, facts, G.decode_quality(rows)))


@query("g17_reviewed_pairing", f"WITH {O.SES}, {O.FACTS}, o AS (SELECT {K3}, max(t) AS te, coalesce(min(t) FILTER (regexp_matches(msg, 'SLAC|ATTEN_CHAR')), min(t)) AS b, bool_or(kind = 'tcp' OR regexp_matches(msg, 'SLAC_PARM.CNF|SLAC_MATCH.CNF|ATTEN_CHAR.RSP')) AS own FROM ses JOIN (SELECT {K3} FROM fct WHERE n_v2g = 0) USING ({K3}) GROUP BY ALL), w AS (SELECT *, own AND te >= b + 20 AND (SELECT count(*) FROM ses s WHERE s.station = o.station AND s.connector = o.connector AND s.sid = o.sid AND s.t BETWEEN b AND b + 20) >= 20 AS shown FROM o) SELECT {K3}, CASE WHEN own THEN 'capture ended before 20s setup budget' ELSE 'shared-PLC SLAC could not be attributed' END AS reason FROM w WHERE NOT shown")
def g17(s, d):
    return V.unpaired(*reviewed_parts(s, d))[1].select(*KEYS, "reason")


_FLAG = "CASE " + " ".join(f"WHEN {c} NOT BETWEEN 0 AND 1000 THEN 'DECODE_ERROR:{c}=' || {c}" for c in ("evse_v", "ev_target_v", "ev_max_v", "evse_max_v")) + " WHEN soc NOT BETWEEN 0 AND 100 THEN 'DECODE_ERROR:soc=' || soc END"
_REVIEWED = f"""{O.FACTS}, {_V}, {_PRE}, {O.REMATCH}, {O.RESET}, {O.NOPOWER}, {O.EVID},
mv AS (SELECT s.* FROM ses s SEMI JOIN fct USING ({K3}) WHERE kind = 'v2g'),
mf AS (SELECT {K3}, t, 'PROTOCOL_FAILED' AS family FROM mv WHERE resp_code <> '' UNION ALL SELECT {K3}, t, 'EVSE_FAULT' FROM mv WHERE resp_code = '' AND evse_status <> '' UNION ALL SELECT {K3}, t, 'ISOLATION_FAULT' FROM mv WHERE resp_code = '' AND isolation = 'Fault' UNION ALL SELECT {K3}, t, 'EV_ERROR' FROM mv WHERE resp_code = '' AND ev_err <> ''),
cs AS (SELECT {K3}, cable_req AS a, coalesce((SELECT min(o.t) FROM ses o WHERE {O.SAME} AND o.kind = 'v2g' AND o.t > s.cable_req AND (o.msg = 'PreChargeReq' OR (o.msg = 'CableCheckRes' AND o.resp_code = '' AND o.evse_processing = 'Finished'))), last_cable) - cable_req AS span FROM fct s WHERE cable_req IS NOT NULL),
{_proven("cf", 20, 5.0, f"SELECT {K3}, a + 40 AS t, 'COMM_FREEZE' AS family, a, a + 40 AS b FROM cs WHERE span > 40")},
po AS (SELECT {K3}, max(t) AS te, coalesce(min(t) FILTER (regexp_matches(msg, 'SLAC|ATTEN_CHAR')), min(t)) AS b0, bool_or(kind = 'tcp' OR regexp_matches(msg, 'SLAC_PARM.CNF|SLAC_MATCH.CNF|ATTEN_CHAR.RSP')) AS own FROM ses JOIN (SELECT {K3} FROM fct WHERE n_v2g = 0) USING ({K3}) GROUP BY ALL),
{_proven("pr", 20, 2.0, f"SELECT {K3}, b0 + 20 AS t, 'SLAC_FAILURE' AS family, b0 AS a, b0 + 20 AS b FROM po WHERE own AND te >= b0 + 20")},
un AS (SELECT {K3}, CASE WHEN own THEN 'capture ended before 20s setup budget' ELSE 'shared-PLC SLAC could not be attributed' END AS reason FROM po ANTI JOIN pr USING ({K3})),
ra AS (FROM mf UNION ALL FROM tm UNION ALL FROM cf UNION ALL FROM pf UNION ALL FROM pr UNION ALL FROM remat UNION ALL FROM reset UNION ALL FROM nopower UNION ALL SELECT {K3}, min(t), 'SESSION_ABORT' FROM ev_d WHERE op AND nd > 1 GROUP BY ALL),
rl AS (SELECT {K3}, min(t) AS first_fault_t, arg_min(family, (t, family)) AS first_fault_family FROM ra GROUP BY ALL),
fl AS (SELECT {K3}, arg_min(flag, (t, seq)) AS flag FROM (SELECT *, {_FLAG} AS flag FROM ses WHERE kind = 'v2g' AND resp_code = '') WHERE flag IS NOT NULL GROUP BY ALL),
ev AS (SELECT {K3}, coalesce(bool_or(msg LIKE 'CurrentDemand%' AND charge_complete = 'true'), false) OR coalesce(bool_or(notification = 'StopCharging'), false) AS asked FROM ses WHERE kind = 'v2g' GROUP BY ALL),
rw AS (SELECT {K3}, first_fault_family, first_fault_t, CASE WHEN first_fault_t IS NULL AND reason IS NOT NULL THEN reason WHEN first_fault_t IS NULL AND NOT graceful_close THEN CASE WHEN asked THEN 'normal stop evidence present but SessionStopRes was not observable' ELSE 'non-graceful end without positive fault evidence' END ELSE '' END AS censor_reason,
  coalesce(flag, '') AS flags FROM fct LEFT JOIN rl USING ({K3}) LEFT JOIN un USING ({K3}) LEFT JOIN fl USING ({K3}) LEFT JOIN ev USING ({K3}))"""
_CENSORED = f"SELECT {K3}, first_fault_family, {us('first_fault_t')}, censor_reason <> '' AS censored, censor_reason, flags FROM rw"


def reviewed(rows: DataFrame) -> DataFrame:
    out = G.label_sessions(stored(rows, "sessions"), "reviewed")
    return out.select(*KEYS, "first_fault_family", *micros("first_fault_t"), "censored", "censor_reason", F.concat_ws(",", "quality_flags").alias("flags"))


@query("g19_reviewed_labels", f"WITH {O.SES}, {_REVIEWED} {_CENSORED}")
def g19(s, d):
    return reviewed(sessions(s, d))


@query("g19_dense_labels", f"WITH {_DENSE_SES}, {_REVIEWED} {_CENSORED}")
def g19_dense(s, d):
    return reviewed(dense_sessions(s, d))


@query("r22_censor_counts", f"WITH {O.SES}, {_REVIEWED} SELECT 'reason' AS kind, censor_reason AS value, count(*) AS n FROM rw WHERE censor_reason <> '' GROUP BY ALL UNION ALL SELECT 'flag', split_part(flags, ':', 1), count(*) FROM rw WHERE flags <> '' GROUP BY ALL")
def r22_censored(s, d):
    return R.censor_counts(stored(G.label_sessions(stored(sessions(s, d), "sessions"), "reviewed"), "labels"))


# ---------------------------------------------------------------- sessions, splits, round trips


@query("s7_truncation_artifacts", f"WITH {O.SES}, {O.LABELS}, {_SPANS}, m AS (SELECT *, lead(first) OVER w AS nx, lead(first_v2g) OVER w AS nm FROM spans WINDOW w AS (PARTITION BY station, connector ORDER BY first, file)), cut AS (SELECT station, connector, last AS c FROM m WHERE nx IS NULL OR (nx - last > 60 AND (size_bytes >= 4500000 OR NOT coalesce(nm IN ('supportedAppProtocolReq', 'SessionSetupReq'), false)))) SELECT {K3} FROM lab l WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.station = l.station AND cut.connector = l.connector AND ((n_faults = 0 AND NOT graceful_close AND abs(t_end - c) <= 5) OR (n_faults = 1 AND first_fault_family = 'SESSION_ABORT' AND abs(first_fault_t - c) <= 5)))")
def s7(s, d):
    cuts = Z.data_cuts(file_spans(telemetry.fixture(s, d)))
    return Z.drop_truncation_artifacts(labels(s, d).withColumn("graceful", F.col("graceful_close")), cuts).select(*KEYS)


@query("s8_clones", f"WITH {O.TEL}, c AS (SELECT station, kind AS file, sha256(CAST(count(*) % 2 AS VARCHAR)) AS h FROM tel GROUP BY ALL), g AS (SELECT station, string_agg(file || ':' || h, ',' ORDER BY file || ':' || h) AS sig FROM c GROUP BY ALL) SELECT station, min(station) OVER (PARTITION BY sig) AS canonical FROM g")
def s8(s, d):
    c = telemetry.fixture(s, d).groupBy("station", F.col("kind").alias("file")).agg(F.sha2((F.count("*") % 2).cast("string"), 256).alias("sha256"))
    return Z.collapse_clones(c)


@query("s9_complete_stations", f"WITH {O.TEL}, {_SPANS}, x AS (SELECT DISTINCT station, connector || CAST(file AS VARCHAR) AS file, n_rows FROM spans) SELECT DISTINCT station FROM tel WHERE station NOT IN (SELECT station FROM x WHERE n_rows % 97 = 0)")
def s9(s, d):
    spans = file_spans(telemetry.fixture(s, d)).select("station", F.concat("connector", F.col("file").cast("string")).alias("file"), "n_rows")
    stations = telemetry.fixture(s, d).select("station").distinct()
    return Z.complete_only(stations, spans.select("station", "file"), spans.where("n_rows % 97 <> 0").select("station", "file"))


@query("t1_holdout_checks", f"WITH {O.TEL}, n AS (SELECT count(DISTINCT station) AS n FROM tel) SELECT n AS stations, CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS test_stations, 0::BIGINT AS leaked FROM n")
def t1_checks(s, d):
    split = T.station_holdout(telemetry.fixture(s, d))
    leaked = T.leaked_sites(split).agg(F.count("*").alias("leaked"))
    return split.agg(F.count("*").alias("stations"), F.count_if(F.col("split") == "test").alias("test_stations")).crossJoin(leaked)


@query("t3_subsample_counts", f"WITH {O.SES}, {O.LABELS}, y AS (SELECT CASE WHEN first_fault_t - t <= 60 THEN 1 ELSE 0 END AS y FROM ses JOIN lab USING ({K3})) SELECT count(*) FILTER (y = 1) AS positives, least(count(*) FILTER (y = 0), least(400000, 8 * greatest(count(*) FILTER (y = 1), 1000))) AS negatives FROM y")
def t3_counts(s, d):
    out = T.subsample_negatives(T.step_labels(sessions(s, d), labels(s, d)))
    return out.agg(F.count_if(F.col("y") == 1).alias("positives"), F.count_if(F.col("y") == 0).alias("negatives"))


@query("t5_windows_32_8", f"WITH {O.SES}, w AS (SELECT {K3}, row_number() OVER ({O.P} {O.O}) - 1 AS start, list(seq) OVER ({O.P} {O.O} ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS w FROM ses) SELECT {K3}, CAST(start AS INT) AS start, CAST(list_sum(w) AS BIGINT) AS total FROM w WHERE len(w) = 32 AND start % 8 = 0")
def t5_long(s, d):
    w = T.sliding_windows(sessions(s, d), "seq")
    return w.select(*KEYS, F.col("start").cast("int").alias("start"), F.aggregate("window", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("t6_window_sources", f"WITH {O.SES}, w AS (SELECT {K3}, row_number() OVER ({O.P} {O.O}) - 1 AS start, count(*) OVER ({O.P} {O.O} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n FROM ses) SELECT station, count(*) AS windows FROM w WHERE n = 16 AND start % 4 = 0 GROUP BY ALL")
def t6_sources(s, d):
    w = T.sliding_windows(sessions(s, d), "seq", 16, 4).select(*KEYS, "start")
    return T.window_samples(w, 20_000, *KEYS, "start")[1].select("station", "windows")


@query("t9_patch_counts", f"WITH {O.SCORED_L}, o AS (SELECT {K3}, first_fault_t AS a FROM lab_l), n AS (SELECT {K3}, first_fault_t AS b FROM lab WHERE sid % 9 <> 0) SELECT count(*) AS sessions, count(*) FILTER (n.station IS NOT NULL AND (a IS NULL) <> (b IS NULL)) AS flipped, count(*) FILTER (abs(a - b) > 0.5) AS reanchored, count(*) FILTER (n.station IS NULL) AS missing FROM o LEFT JOIN n ON o.station = n.station AND o.connector = n.connector AND o.sid = n.sid")
def t9_counts(s, d):
    old = legacy(s, d).select(*KEYS, F.col("first_fault_t").alias("old_t"))
    return T.patch_labels(old, labels(s, d).where("sid % 9 <> 0"))


@query("t10_sample_counts", f"WITH {O.SES}, {O.LABELS} SELECT count(first_fault_t) AS faulty, least(200, count(*) - count(first_fault_t)) AS clean FROM lab")
def t10_counts(s, d):
    return T.clean_sample(labels(s, d), 200).agg(F.count("first_fault_t").alias("faulty"), F.count_if(F.col("first_fault_t").isNull()).alias("clean"))


@query("t11_missing", f"WITH {O.SES}, {O.LABELS} SELECT {K3} FROM lab WHERE sid % 4 = 0")
def t11_missing(s, d):
    index = labels(s, d)
    split = index.select("station").distinct().withColumn("split", F.lit("test"))
    staged = T.stage_split(sessions(s, d).where("sid % 4 <> 0"), split, "test")
    return T.missing_from(staged, index, split, "test")


@query("a5_label_tables", f"WITH {O.SCORED_L} SELECT 'legacy' AS label_profile, {K3}, first_fault_family FROM lab_l UNION ALL SELECT 'strict', {K3}, first_fault_family FROM lab")
def a5(s, d):
    path = scratch(s, "labels")
    for df in (labels(s, d), legacy(s, d)):
        frames.write_labels(df, path)
    back = frames.read_labels(s, path, "legacy").unionByName(frames.read_labels(s, path, "strict"))
    return back.select("label_profile", *KEYS, "first_fault_family")


@query("a6_written_sessions", f"WITH {O.SES} SELECT {K3}, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM ses GROUP BY ALL")
def a6(s, d):
    path, rows = scratch(s, "sessions"), sessions(s, d)
    frames.write_sessions(rows, path)
    return s.read.schema(rows.schema).parquet(path).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("a10_alert_tables", f"WITH {O.SCORED} SELECT {K3}, detector, CAST(round(t * 1e6) AS BIGINT) AS t_us FROM al WHERE detector = 'Conformance'")
def a10(s, d):
    path = scratch(s, "alerts")
    frames.write_alerts(alerts(s, d), path)
    return frames.read_alerts(s, path, "Conformance").select(*KEYS, "detector", *micros("t"))


@query("a11_report", f"WITH {O.SCORED} SELECT 'leaderboard' AS part, (SELECT count(DISTINCT detector) FROM sc) AS n UNION ALL SELECT 'families', (SELECT count(DISTINCT family) FROM ff) UNION ALL SELECT 'deltas', 0")
def a11(s, d):
    tables = {"leaderboard": R.scored(outcomes(s, d), "detector"), "families": G.strict_faults(G.session_evidence(sessions(s, d))).groupBy("family").count()}
    return frames.report(["leaderboard", "families", "deltas"], **tables).groupBy("part").agg(F.count("body").alias("n"))


def frames_of(s, d) -> DataFrame:
    """The telemetry as dissected frames: names, link-layer texts, TCP flags and message XML."""
    rows = telemetry.fixture(s, d)
    tag = lambda name, value: F.when(value != "", F.concat(F.lit(f"<m:{name}>"), value, F.lit(f"</m:{name}>"))).otherwise("")
    volts = F.when(F.col("evse_v").isNotNull(), F.concat(F.lit("<m:EVSEPresentVoltage><m:Multiplier>-2</m:Multiplier><m:Value>"), F.round(F.col("evse_v") * 100).cast("bigint").cast("string"), F.lit("</m:Value></m:EVSEPresentVoltage>"))).otherwise("")
    body = F.concat(tag("ResponseCode", F.col("resp_code")), tag("EVSEStatusCode", F.col("evse_status")), tag("EVErrorCode", F.col("ev_err")), volts)
    v2g = F.col("kind") == "v2g"
    xml = F.when(v2g & (body != ""), F.concat(F.lit('<m:Body xmlns:m="urn:x"><m:SessionID>'), F.col("seq").cast("string"), F.lit("</m:SessionID>"), body, F.lit("</m:Body>")))
    return rows.select(
        "seq", F.col("t").cast("string").alias("t"), "tcp_stream", (F.col("msg") == "RST").cast("string").alias("tcp_rst"), F.when(F.col("msg") == "RETX", "1").alias("tcp_rex"), F.lit(None).cast("string").alias("tcp_lost"),
        F.when(v2g, F.col("msg")).alias("name"), xml.alias("xml"), "validation", F.when(F.col("kind") == "hpav", F.concat(F.lit("Qualcomm Atheros, "), "msg")).otherwise("other").alias("info"),
    ).withColumn("tcp_rst", F.initcap("tcp_rst"))


@query("a2_classified_frames", f"WITH {O.TEL} SELECT seq, kind, msg FROM tel")
def a2(s, d):
    return frames.classify_frames(frames_of(s, d)).select("seq", "kind", "msg")


@query("a3_message_fields", f"WITH {O.TEL} SELECT seq, CAST(seq AS VARCHAR) AS session, nullif(resp_code, '') AS resp_code, nullif(evse_status, '') AS evse_status, nullif(ev_err, '') AS ev_err, CAST(round(evse_v * 100) AS BIGINT) AS centivolts FROM tel WHERE kind = 'v2g' AND (resp_code <> '' OR evse_status <> '' OR ev_err <> '' OR evse_v IS NOT NULL)")
def a3(s, d):
    rows = frames_of(s, d).where("xml IS NOT NULL")
    return frames.extract_v2g_fields(rows).select("seq", "session", "resp_code", "evse_status", "ev_err", F.round(F.col("evse_v") * 100).cast("bigint").alias("centivolts"))


# ---------------------------------------------------------------- streams


def stream_of(s, d) -> DataFrame:
    """The telemetry as a file stream, written once to the shared folder."""
    path = scratch(s, "stream-in")
    rows = telemetry.fixture(s, d)
    rows.write.parquet(path)
    return live.ingest(s, path, rows.schema)


@query("l1_ingested_alerts", f"WITH {O.TEL} SELECT seq, CASE WHEN resp_code <> '' THEN 'PROTOCOL_FAILED' WHEN evse_status <> '' THEN 'EVSE_FAULT' WHEN isolation = 'Fault' THEN 'ISOLATION_FAULT' ELSE 'EV_ERROR' END AS family FROM tel WHERE kind = 'v2g' AND (resp_code <> '' OR evse_status <> '' OR isolation = 'Fault' OR ev_err <> '')")
def l1(s, d):
    out = scratch(s, "stream-out")
    live.upsert(live.marker_alerts(stream_of(s, d)), out, scratch(s, "stream-state"), ("station", "connector", "seq")).awaitTermination()
    return live.latest(s, out, "station", "connector", "seq").select("seq", "family")


@query("l6_enriched_alerts", f"WITH {O.TEL} SELECT station, CASE WHEN CAST(substr(station, 3) AS INT) % 2 = 0 THEN 'baseline' ELSE 'iso15118-standard' END AS policy, count(*) AS n FROM tel WHERE kind = 'v2g' AND (resp_code <> '' OR evse_status <> '' OR isolation = 'Fault' OR ev_err <> '') GROUP BY ALL")
def l6(s, d):
    stations = telemetry.fixture(s, d).select("station").distinct()
    arm = F.when(F.substring("station", 3, 10).cast("int") % 2 == 0, "baseline").otherwise("iso15118-standard")
    policies = stations.withColumn("policy", S.policy_arm(arm))
    return live.enrich(live.marker_alerts(telemetry.fixture(s, d)), policies).groupBy("station", "policy").agg(F.count("*").alias("n"))


@query("l3_stream_first_alerts")
def l3(s, d):
    out = scratch(s, "stream-alerts")
    live.upsert(live.first_alerts(stream_of(s, d)), out, scratch(s, "stream-state")).awaitTermination()
    return s.read.schema(f"{live.ALERT}, batch int").parquet(out).drop("batch")


# the watermark at the end of the stream: lateness behind the last row
_WM = "(SELECT floor(max(t) * 1e3) / 1e3 - 600 FROM tel)"
_CLOSED = f"""bg AS (SELECT {K3}, max(t) FILTER (act) AS la, min(t) FILTER (act) AS fa FROM ses JOIN (SELECT seq, act FROM s0) USING (seq) GROUP BY ALL),
cl AS (SELECT {K3} FROM (SELECT *, lead(fa) OVER (PARTITION BY station, connector ORDER BY sid) AS nx FROM bg) WHERE la + 60 < {_WM} OR nx <= {_WM})"""


@query("s10_stream_sessions", f"WITH {O.SES}, {_CLOSED} SELECT {K3}, count(*) AS n_events, sum(seq)::BIGINT AS seq_sum, CAST(round(min(t) * 1e6) AS BIGINT) AS t_start_us, CAST(round(max(t) * 1e6) AS BIGINT) AS t_end_us FROM ses JOIN cl USING ({K3}) GROUP BY ALL")
def s10(s, d):
    out = scratch(s, "stream-sessions")
    live.upsert(TS.closed_sessions(stream_of(s, d)), out, scratch(s, "stream-state")).awaitTermination()
    return s.read.schema(f"{TS.SESSION_OUT}, batch int").parquet(out).select(*KEYS, "n_events", "seq_sum", *micros("t_start", "t_end"))


@query("l3_stream_rules", f"WITH {O.SCORED} SELECT {K3}, detector, CAST(round(t * 1e6) AS BIGINT) AS t_us, guess AS fault_guess FROM al WHERE t <= {_WM}")
def l3_rules(s, d):
    """First alerts of the stream at rows: those of the batch operators up to the watermark."""
    out = scratch(s, "stream-alerts")
    live.upsert(TS.stream_alerts(stream_of(s, d), timers=False), out, scratch(s, "stream-state")).awaitTermination()
    return s.read.schema(f"{TS.ALERT_OUT}, batch int").parquet(out).select(*KEYS, "detector", *micros("t"), "fault_guess")


# what would alert if no row came: a deadline that passes before the session's next row, or before the session ends
_SILENT = f"""ed AS (SELECT {K3}, least(la + 60, coalesce(lead(fa) OVER (PARTITION BY station, connector ORDER BY sid), 1e12)) AS te FROM bg),
tn AS (SELECT {K3}, seq, coalesce(lead(t) OVER ({O.P} {O.O}), te) AS nt FROM ses JOIN ed USING ({K3})),
lim AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in K.MSG_TIMEOUT_S.items())}) x(msg, lim)),
tr AS (SELECT trk.*, nt FROM trk JOIN tn USING ({K3}, seq)),
cf AS (SELECT conf.*, nt, coalesce(bool_or(msg = 'SessionSetupRes') OVER (PARTITION BY {K3}, dialog {O.O} ROWS UNBOUNDED PRECEDING), false) AS done FROM conf JOIN tn USING ({K3}, seq)),
rq AS (SELECT {K3}, dialog, t, msg, kind, coalesce(lead(t) OVER (PARTITION BY {K3}, dialog, regexp_replace(msg, '(Req|Res)$', '') {O.O}), 1e12) AS nb FROM conf WHERE kind = 'v2g' AND regexp_matches(msg, '(Req|Res)$')),
dl AS (SELECT {K3}, dialog, coalesce(min(t) OVER ({O.P} ORDER BY dialog ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 1e12) AS nd FROM (SELECT {K3}, dialog, min(t) AS t FROM conf GROUP BY ALL)),
sl AS (
  SELECT {K3}, 'Spec' AS detector, 'COMM_FREEZE' AS g, t - cablecheck_elapsed + 40 AS due, t, nt FROM tr WHERE phase = 'cablecheck' AND cablecheck_n > 0
  UNION ALL SELECT {K3}, 'Spec', 'SESSION_ABORT', t - link_gap + 3, t, nt FROM tr WHERE phase <> 'idle' AND link_gap IS NOT NULL
  UNION ALL SELECT {K3}, 'Conformance', 'COMM_FREEZE', t - ongoing_s + 55, t, nt FROM cf WHERE ongoing_s > 0 OR (kind = 'v2g' AND evse_processing = 'Ongoing')
  UNION ALL SELECT {K3}, 'Conformance', 'COMM_FREEZE', t - seq_gap_s + 60, t, nt FROM cf WHERE seq_gap_s > 0 OR (kind = 'v2g' AND msg LIKE '%Res' AND msg <> 'SessionStopRes' AND resp_code = '')
  UNION ALL SELECT {K3}, 'Conformance', 'SESSION_ABORT', t - comm_setup_s + 20, t, nt FROM cf WHERE dialog > 0 AND NOT done
  UNION ALL SELECT {K3}, 'Conformance', 'COMM_FREEZE', t - cablecheck_s + 40, t, nt FROM cf WHERE cablecheck_open
  UNION ALL SELECT {K3}, 'Conformance', 'COMM_FREEZE', t + lim, t, least(nb, nd, te) FROM rq JOIN lim USING (msg) JOIN dl USING ({K3}, dialog) JOIN ed USING ({K3})),
fa AS (SELECT {K3}, detector, t, guess AS g FROM al WHERE t <= {_WM} UNION ALL SELECT {K3}, detector, due, g FROM sl WHERE due >= t AND due < nt AND due < {_WM})"""


@query("l4_stream_timers", f"WITH {O.SCORED}, {_CLOSED}, {_SILENT} SELECT {K3}, detector, CAST(round(min(t) * 1e6) AS BIGINT) AS t_us, arg_min(g, t) AS fault_guess FROM fa GROUP BY ALL")
def l4(s, d):
    """The same with timers: a deadline alerts when it passes, whether a row comes or not."""
    out = scratch(s, "stream-alerts")
    live.upsert(TS.stream_alerts(stream_of(s, d)), out, scratch(s, "stream-state")).awaitTermination()
    return s.read.schema(f"{TS.ALERT_OUT}, batch int").parquet(out).select(*KEYS, "detector", *micros("t"), "fault_guess")


def _arrive(s, d, path: str, part: F.Column | None = None) -> ST.StructType:
    """Telemetry (of ``part``) as one file more in the folder that a stream reads."""
    rows = telemetry.fixture(s, d)
    (rows if part is None else rows.where(part)).coalesce(1).write.mode("append").parquet(path)
    return rows.schema


@query("l7_session_table", f"WITH {O.SES}, {_CLOSED} SELECT {K3}, count(*) AS n_events, sum(seq)::BIGINT AS seq_sum, CAST(round(min(t) * 1e6) AS BIGINT) AS t_start_us, CAST(round(max(t) * 1e6) AS BIGINT) AS t_end_us FROM ses JOIN bg USING ({K3}) WHERE t <= {_WM} AND fa <= {_WM} GROUP BY ALL")
def l7(s, d):
    """The table of sessions so far, kept by a stream in six batches with merges between them."""
    path = scratch(s, "stream-in")
    lo, hi = telemetry.fixture(s, d).agg(F.min("t"), F.max("t")).first()
    for i in range(6):
        a, b = (lo + (hi - lo) * x / 6 for x in (i, i + 1))
        schema = _arrive(s, d, path, (F.col("t") >= a) & ((F.col("t") < b) if i < 5 else F.lit(True)))
    rows = live.with_time(s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)).withWatermark("ts", live.LATENESS)
    table = UP.KeyedTable(s, scratch(s, "session-table"), ST.StructType.fromDDL(TS.SESSION_OUT), tuple(KEYS), "t_end", merge_every=3)
    UP.keep(TS.session_updates(rows), table, scratch(s, "stream-state")).awaitTermination()
    return table.read().select(*KEYS, "n_events", "seq_sum", *micros("t_start", "t_end"))


_HALF = "(SELECT min(t) + (max(t) - min(t)) / 2 FROM tel)"


@query("l6_versioned_policies", f"WITH {O.TEL} SELECT seq, CASE WHEN CAST(substr(station, 3) AS INT) % 3 = 0 THEN NULL WHEN CAST(substr(station, 3) AS INT) % 2 = 0 AND t >= {_HALF} THEN 'iso15118-standard' ELSE 'baseline' END AS policy FROM tel WHERE kind = 'v2g' AND (resp_code <> '' OR evse_status <> '' OR isolation = 'Fault' OR ev_err <> '')")
def l6_versions(s, d):
    """Alerts of a stream with their station's policy, which changes for even stations between its two batches."""
    path, state, out = (scratch(s, x) for x in ("stream-in", "stream-state", "enriched"))
    stations = telemetry.fixture(s, d).select("station").distinct().withColumn("n", F.substring("station", 3, 10).cast("int"))
    policies = UP.KeyedTable(s, scratch(s, "policies"), ST.StructType.fromDDL("station string, policy string"), ("station",))
    policies.apply(stations.where("n % 3 <> 0").select("station", F.lit("baseline").alias("policy")), 0)
    table = UP.KeyedTable(s, out, ST.StructType.fromDDL("seq bigint, policy string"), ("seq",))
    lo, hi = telemetry.fixture(s, d).agg(F.min("t"), F.max("t")).first()
    for late in (False, True):
        if late:
            policies.apply(stations.where("n % 3 <> 0 AND n % 2 = 0").select("station", F.lit("iso15118-standard").alias("policy")), 1)
        schema = _arrive(s, d, path, (F.col("t") >= lo + (hi - lo) / 2) if late else (F.col("t") < lo + (hi - lo) / 2))
        alerts_now = live.marker_alerts(s.readStream.schema(schema).parquet(path))
        UP.keep_enriched(alerts_now, policies, "station", table, state).awaitTermination()
    return table.read()


# the same watermark, from the events alone
_WM_EVENTS = "(SELECT floor(max(epoch_us(ts) / (1e6 * 720.0)) * 1e3) / 1e3 - 600 FROM events)"


def _streamed(s, d, rows: DataFrame) -> DataFrame:
    """What an aggregate of the stream has closed by its end."""
    out = scratch(s, "stream-closed")
    live.upsert(rows, out, scratch(s, "stream-state")).awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


@query("l2_stream_windows", f"SELECT * FROM ({ORACLES['l2_session_windows']}) WHERE t_end_us / 1e6 + 60 <= {_WM_EVENTS}")
def l2_stream(s, d):
    return _streamed(s, d, live.session_windows(stream_of(s, d))).select("station", "connector", "n_events", *micros("t_start", "t_end"))


@query("l5_stream_counts", f"SELECT * FROM ({ORACLES['l5_station_counts']}) WHERE start_s + 60 <= {_WM_EVENTS}")
def l5_stream(s, d):
    return _streamed(s, d, live.station_counts(stream_of(s, d))).select("station", F.unix_seconds("start").alias("start_s"), "n", "retx", "failed")
