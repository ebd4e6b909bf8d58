"""Queries of conformance, matching, labelling, detection and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detection as D
from ..operators import features as X
from ..operators import labels as G
from ..operators import scoring as R
from ..operators import sessions as Z
from . import oracle_base as O
from . import feature_queries as Q
from .feature_queries import micros, query, us
from .tables import stored

K3 = O.K3
NAMES = ("Spec", "Conformance")


sessions = Q.sessions


def tracked(s, d) -> DataFrame:
    return X.tracked(sessions(s, d))


def conformance(s, d) -> DataFrame:
    return X.conformance(sessions(s, d))


def everything(s, d) -> DataFrame:
    return X.conformance(tracked(s, d))


def all_tools(s, d) -> DataFrame:
    return X.matching(X.conformance(X.smoothed(stored(tracked(s, d), "tracked"))))  # smoothing reads its rows twice


def evidence(s, d) -> DataFrame:
    return G.is_session(G.session_evidence(sessions(s, d)))


def faults(s, d, part) -> DataFrame:
    """First candidate of a part of the rules per session and family."""
    return part(evidence(s, d)).select(*Z.SESSION, "family", *micros("t"))


def fault_sql(name: str, ctes: str) -> str:
    return f"WITH {O.SES}, {O.FACTS}, {ctes} SELECT {K3}, family, CAST(round(min(t) * 1e6) AS BIGINT) AS t_us FROM {name} GROUP BY ALL"


@query("c1_dialogs", f"WITH {O.CONF} SELECT seq, dialog FROM conf")
def c1(s, d):
    return X.dialogs(sessions(s, d)).select("seq", F.col("dialog").cast("bigint").alias("dialog"))


@query("c2_message_timeouts", f"WITH {O.CONF} SELECT seq, {us('msg_timeout_ratio', 'msg_timeout_max')}, n_msg_breach FROM conf")
def c2(s, d):
    return X.message_timers(X.dialogs(sessions(s, d))).select("seq", *micros("msg_timeout_ratio", "msg_timeout_max"), F.col("n_msg_breach").cast("bigint").alias("n_msg_breach"))


@query("c3_message_performance", f"WITH {O.CONF} SELECT seq, {us('msg_perf_ratio')} FROM conf")
def c3(s, d):
    return X.message_timers(X.dialogs(sessions(s, d))).select("seq", *micros("msg_perf_ratio"))


@query("c4_sequence_timer", f"WITH {O.CONF} SELECT seq, {us('seq_gap_s')}, n_seq_breach FROM conf")
def c4(s, d):
    return X.sequence_timer(X.dialogs(sessions(s, d))).select("seq", *micros("seq_gap_s"), F.col("n_seq_breach").cast("bigint").alias("n_seq_breach"))


@query("c5_ongoing", f"WITH {O.CONF} SELECT seq, {us('ongoing_s')}, ongoing_s >= 55 AS ongoing_breach FROM conf")
def c5(s, d):
    return X.ongoing_timer(X.dialogs(sessions(s, d))).select("seq", *micros("ongoing_s"), "ongoing_breach")


@query("c6_comm_setup", f"WITH {O.CONF} SELECT seq, {us('comm_setup_s')} FROM conf")
def c6(s, d):
    return X.setup_timer(X.dialogs(sessions(s, d))).select("seq", *micros("comm_setup_s"))


@query("c7_cable_check", f"WITH {O.CONF} SELECT seq, {us('cablecheck_s')}, cablecheck_open, cablecheck_open AND cablecheck_s >= 40 AS cablecheck_breach FROM conf")
def c7(s, d):
    return X.cable_and_precharge(X.dialogs(sessions(s, d))).select("seq", *micros("cablecheck_s"), "cablecheck_open", "cablecheck_breach")


@query("c8_precharge", f"WITH {O.CONF} SELECT seq, {us('precharge_s', 'precharge_v_gap_ratio')}, precharge_s >= 7 AS precharge_breach FROM conf")
def c8(s, d):
    return X.cable_and_precharge(X.dialogs(sessions(s, d))).select("seq", *micros("precharge_s", "precharge_v_gap_ratio"), "precharge_breach")


@query("c9_illegal_successor", f"WITH {O.CONF} SELECT seq, seq_illegal, n_seq_illegal FROM conf")
def c9(s, d):
    return X.sequence_legality(X.dialogs(sessions(s, d))).select("seq", "seq_illegal", F.col("n_seq_illegal").cast("bigint").alias("n_seq_illegal"))


@query("c10_stages", f"WITH {O.CONF} SELECT seq, CAST(stage_max AS BIGINT) AS stage_max, stage_regress FROM conf")
def c10(s, d):
    return X.sequence_legality(X.dialogs(sessions(s, d))).select("seq", F.col("stage_max").cast("bigint").alias("stage_max"), "stage_regress")


@query("c11_over_maxima", f"WITH {O.CONF} SELECT seq, {us('v_over_max', 'i_over_max')} FROM conf WHERE evse_v IS NOT NULL")
def c11(s, d):
    return X.severities(sessions(s, d)).where("evse_v IS NOT NULL").select("seq", *micros("v_over_max", "i_over_max"))


def _matching(name: str, columns: list[str], seconds: list[str]):
    @query(name, f"WITH {O.MATCH} SELECT seq, {', '.join([*columns, us(*seconds)] if seconds else columns)} FROM mat")
    def run(s, d):
        rows = X.matching(sessions(s, d))
        return rows.select("seq", *[F.col(c) if c in ("matched", "v2g_seen", "match_pending", "awaiting") else F.col(c).cast("bigint" if c != "slac_stage" else "int").alias(c) for c in columns], *micros(*seconds))


_matching("m1_slac_stage", ["slac_stage", "matched", "v2g_seen"], [])
_matching("m2_match_pending", ["match_pending"], ["match_pending_s"])
_matching("m3_awaiting_request", ["awaiting"], ["awaiting_s"])
_matching("m4_restarts", ["n_restart"], [])
_matching("m5_since_match", ["n_match_req"], ["since_match_s"])


@query("g1_markers", f"WITH {O.SES}, {O.MARK} SELECT {K3}, family, CAST(round(t * 1e6) AS BIGINT) AS t_us FROM mark")
def g1(s, d):
    return G.marker_faults(sessions(s, d)).select(*Z.SESSION, "family", *micros("t"))


@query("g2_graceful", f"WITH {O.SES}, {O.FACTS} SELECT {K3}, graceful_close FROM fct")
def g2(s, d):
    return G.is_session(G.session_facts(sessions(s, d))).select(*Z.SESSION, "graceful_close")


@query("g3_delivery", f"WITH {O.SES}, {O.FACTS} SELECT {K3}, reached_current_demand, {us('first_cd', 'last_cd')} FROM fct")
def g3(s, d):
    return G.is_session(G.session_facts(sessions(s, d))).select(*Z.SESSION, "reached_current_demand", *micros("first_cd", "last_cd"))


@query("g4_cable_stuck", fault_sql("stuck", O.STUCK))
def g4(s, d):
    return faults(s, d, G.cable_stuck)


@query("g5_delivery_stall", fault_sql("stall", O.STALL))
def g5(s, d):
    return faults(s, d, G.delivery_stalls)


@query("g6_slac_failure", fault_sql("slacf", O.SLACF))
def g6(s, d):
    return faults(s, d, G.slac_failures)


@query("g7_slow_pairing", fault_sql("slow", O.SLACF))
def g7(s, d):
    return faults(s, d, G.slow_pairing)


@query("g8_rematch", fault_sql("remat", O.REMATCH))
def g8(s, d):
    return faults(s, d, G.rematch_aborts)


@query("g9_tcp_reset", fault_sql("reset", f"{O.REMATCH}, {O.RESET}"))
def g9(s, d):
    return faults(s, d, G.reset_aborts)


@query("g10_abort_evidence", fault_sql("evid", f"{O.REMATCH}, {O.RESET}, {O.EVID}"))
def g10(s, d):
    return faults(s, d, G.abort_evidence)


@query("g11_legacy_abort", fault_sql("legacy", f"{O.REMATCH}, {O.RESET}, legacy AS (SELECT {K3}, t_end AS t, 'SESSION_ABORT' AS family FROM rest WHERE ({K3}) NOT IN (SELECT ({K3}) FROM reset))"))
def g11(s, d):
    return faults(s, d, G.legacy_aborts)


@query("g12_no_power", fault_sql("nopower", O.NOPOWER))
def g12(s, d):
    return faults(s, d, G.no_power)


@query("g13_alive_after", f"WITH {O.SES} SELECT {K3}, seq, (SELECT count(*) FROM ses o WHERE {O.SAME} AND o.t > s.t AND o.t <= s.t + 10) AS alive_rows FROM ses s WHERE msg LIKE '%Req'")
def g13(s, d):
    rows = sessions(s, d)
    asks = rows.where(F.col("msg").endswith("Req")).where("kind = 'v2g'").select(*Z.SESSION, "seq", F.col("t").alias("at"))
    return G.alive_after(rows, asks).select(*Z.SESSION, "seq", "alive_rows")


@query("g18_first_faults", f"WITH {O.SES}, {O.LABELS} SELECT {K3}, family, CAST(round(t * 1e6) AS BIGINT) AS t_us FROM ff")
def g18(s, d):
    return G.strict_faults(evidence(s, d)).select(*Z.SESSION, "family", *micros("t"))


@query("g20_labels", f"WITH {O.SES}, {O.LABELS} SELECT {K3}, n_events, graceful_close, reached_current_demand, {us('first_fault_t')}, first_fault_family, array_to_string(families, ',') AS families FROM lab")
def g20(s, d):
    out = labels(s, d)
    return out.select(*Z.SESSION, "n_events", "graceful_close", "reached_current_demand", *micros("first_fault_t"), "first_fault_family", F.concat_ws(",", F.array_sort("faults.family")).alias("families"))


@query("b19_decode_quality", f"WITH {O.SES} SELECT {K3}, count(*) AS n FROM ses WHERE kind = 'v2g' AND resp_code = '' AND (evse_v NOT BETWEEN 0 AND 1000 OR ev_target_v NOT BETWEEN 0 AND 1000 OR soc NOT BETWEEN 0 AND 100) GROUP BY ALL")
def b19(s, d):
    return G.decode_quality(sessions(s, d)).groupBy(*Z.SESSION).agg(F.count("*").alias("n"))


def _detector(name, oracle_rows, rule, build, alert):
    @query(name, f"WITH {oracle_rows} SELECT {K3}, CAST(round(arg_min(t, (t, seq)) * 1e6) AS BIGINT) AS t_us, arg_min(g, (t, seq)) AS fault_guess FROM (SELECT *, {rule} AS g FROM {{}}) WHERE g IS NOT NULL GROUP BY ALL".format("trk" if rule is O.SPEC else "conf" if rule is O.CONFR else "mat"))
    def run(s, d):
        return D.first_alerts(alert(build(s, d)), name).select(*Z.SESSION, *micros("t"), "fault_guess")


_detector("d1_spec_rules", O.TRACK, O.SPEC, tracked, D.spec_rules)
_detector("d2_conformance_rules", O.CONF, O.CONFR, conformance, D.conformance_rules)
_detector("d3_matching_rules", O.MATCH, "CASE WHEN NOT v2g_seen AND ((match_pending AND match_pending_s >= 0.6) OR (awaiting AND awaiting_s >= 10)) THEN 'SLAC_FAILURE' END", lambda s, d: X.matching(sessions(s, d)), lambda rows: D.matching_rules(rows, "both"))


@query("d5_cadence", f"WITH {O.SES} SELECT seq FROM (SELECT seq, row_number() OVER ({O.P} {O.O}) AS n FROM ses WHERE kind = 'v2g') WHERE n % 4 = 0")
def d5(s, d):
    return D.cadence(sessions(s, d)).select("seq")


def alerts(s, d, names=NAMES, rows: DataFrame | None = None) -> DataFrame:
    rows = sessions(s, d) if rows is None else rows
    return D.all_first_alerts(X.conformance(X.tracked(rows)), list(names))


@query("d4_first_alerts", f"WITH {O.SCORED} SELECT {K3}, detector, CAST(round(t * 1e6) AS BIGINT) AS t_us, guess AS fault_guess FROM al")
def d4(s, d):
    return alerts(s, d).select(*Z.SESSION, "detector", *micros("t"), "fault_guess")


def _names(s):
    return s.createDataFrame([(n,) for n in NAMES], "detector string")


def labels(s, d) -> DataFrame:
    return G.label_sessions(sessions(s, d))


def outcomes(s, d) -> DataFrame:
    rows = stored(sessions(s, d), "sessions")  # labels and alerts read the same sessions
    return R.outcomes(stored(G.label_sessions(rows), "labels"), alerts(s, d, rows=rows), _names(s))


_METRICS = """count(*) AS sessions, count(first_fault_t) AS n_faulty, count(*) - count(first_fault_t) AS n_clean, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'late') AS late, count(*) FILTER (outcome = 'miss') AS miss,
count(*) FILTER (outcome = 'fp') AS fp, coalesce(sum(least(lead, 120) / 120), 0) AS early, coalesce(list_sort(list(lead) FILTER (lead IS NOT NULL))[len(list(lead) FILTER (lead IS NOT NULL)) // 2 + 1], 0) AS median_lead"""
_RATES = "coalesce(tp / nullif(n_faulty, 0), 0) AS recall, coalesce(fp / nullif(n_clean, 0), 0) AS far, coalesce(early / nullif(n_faulty, 0), 0) AS earliness"
_OUT = "sessions, n_faulty, n_clean, tp, late, miss, fp, CAST(round(median_lead * 1e6) AS BIGINT) AS median_lead_us, CAST(round(recall * 1e6) AS BIGINT) AS recall_us, CAST(round(far * 1e6) AS BIGINT) AS far_us, CAST(round((50 * recall + 30 * (1 - far) + 20 * earliness) * 1e6) AS BIGINT) AS score_us"
_COLS = ("sessions", "n_faulty", "n_clean", "tp", "late", "miss", "fp")


def board_sql(keys: str) -> str:
    return f"WITH {O.SCORED}, g AS (SELECT {keys}, {_METRICS} FROM sc GROUP BY {keys}), h AS (SELECT *, {_RATES} FROM g) SELECT {keys}, {_OUT} FROM h"


def board(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *_COLS, *micros("median_lead", "recall", "far", "score"))


@query("r1_score_detectors", board_sql("detector"))
def r1(s, d):
    return board(R.scored(outcomes(s, d), "detector"), "detector")


@query("r2_leads", f"WITH {O.SCORED}, g AS (SELECT detector, {_METRICS}, coalesce(avg(lead), 0) AS mean_lead FROM sc GROUP BY 1) SELECT detector, {us('median_lead')}, CAST(round(mean_lead * 1e3) AS BIGINT) AS mean_lead_ms FROM g")
def r2(s, d):
    return R.scored(outcomes(s, d), "detector").select("detector", *micros("median_lead"), F.round(F.col("mean_lead") * 1e3).cast("bigint").alias("mean_lead_ms"))


@query("r3_recall_by_family", f"WITH {O.SCORED} SELECT detector, first_fault_family AS family, count(*) AS n, count(*) FILTER (outcome = 'tp') AS tp FROM sc WHERE n_faults > 0 GROUP BY ALL")
def r3(s, d):
    return R.recall_by_family(outcomes(s, d)).select("detector", "family", "n", "tp")


@query("r4_wins", f"WITH {O.SCORED}, b AS (SELECT *, min(alert_t) OVER (PARTITION BY {K3}) AS best FROM sc WHERE outcome = 'tp'), w AS (SELECT *, count(*) OVER (PARTITION BY {K3}) AS n FROM b WHERE alert_t - best <= 0.1) SELECT detector, CAST(round(sum(1.0::DOUBLE / n) * 1e3) AS BIGINT) AS wins_milli FROM w GROUP BY ALL")
def r4(s, d):
    return R.wins(outcomes(s, d)).select("detector", F.round(F.col("wins") * 1e3).cast("bigint").alias("wins_milli"))


@query("r5_by_connector_spread", f"WITH {O.SCORED}, g AS (SELECT detector, connector, {_METRICS} FROM sc GROUP BY 1, 2), h AS (SELECT detector, connector, coalesce(tp / nullif(n_faulty, 0), 0) AS recall FROM g) SELECT detector, CAST(round((max(recall) - min(recall)) * 1e6) AS BIGINT) AS spread_us FROM h GROUP BY ALL")
def r5(s, d):
    return R.scored(outcomes(s, d), "detector", "connector").groupBy("detector").agg((F.max("recall") - F.min("recall")).alias("spread")).select("detector", *micros("spread"))


@query("r6_fault_rate_top", f"WITH {O.SES}, {O.LABELS}, g AS (SELECT station, count(*) AS n, count(first_fault_t) AS f FROM lab GROUP BY 1) SELECT station, n, f, CAST(round(f / n * 1e6) AS BIGINT) AS rate_us FROM g ORDER BY f / n DESC, station LIMIT 15")
def r6(s, d):
    return R.fault_rates(labels(s, d)).select("station", "n", F.col("faulty").alias("f"), *micros("rate"))


@query("r7_station_rollup", board_sql("station, detector"))
def r7(s, d):
    return board(R.station_rollup(outcomes(s, d)), "station", "detector")


@query("r7_top_family", f"WITH {O.SES}, {O.LABELS}, c AS (SELECT station, first_fault_family AS f, count(*) AS n FROM lab WHERE n_faults > 0 GROUP BY ALL) SELECT station, arg_min(f, (-n, f)) AS top_family FROM c GROUP BY ALL")
def r7b(s, d):
    return R.top_family(labels(s, d), "station")


@query("r8_levels", f"WITH {O.SES}, {O.LABELS}, x AS (SELECT *, coalesce(first_fault_family, 'none') AS family FROM lab) SELECT station, connector, family, count(*) AS sessions, count(first_fault_t) AS n_faulty FROM x GROUP BY GROUPING SETS ((station), (station, connector), (station, family))")
def r8(s, d):
    rows = labels(s, d).withColumn("outcome", F.lit("none"))
    return R.levels(rows).select("station", "connector", "family", "sessions", "n_faulty")


@query("r9_violations", f"WITH {O.TEL} SELECT station AS detector, msg AS rule FROM tel WHERE false")
def r9(s, d):
    o = outcomes(s, d)
    return R.violations(R.scored(o, "detector"), R.recall_by_family(o), R.scored(o, "station", "detector"))


@query("r10_rank", board_sql("detector").replace("SELECT detector, sessions", "SELECT detector, CAST(row_number() OVER (ORDER BY 50 * recall + 30 * (1 - far) + 20 * earliness DESC, detector) AS INT) AS rank, sessions", 1))
def r10(s, d):
    return board(R.ranked(R.scored(outcomes(s, d), "detector")), "detector", "rank")


_W = "CASE first_fault_family " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in R.FAMILY_WEIGHT.items()) + " ELSE 0.65::DOUBLE END"


@query("r11_station_health", f"""WITH {O.SES}, {O.LABELS}, c AS (SELECT station, connector, count(*) AS n, 100.0::DOUBLE * count(first_fault_t) / count(*) AS rate FROM lab GROUP BY ALL),
cc AS (SELECT station, max(rate) FILTER (n >= 20) AS worst, avg(least(n / 50 * 100, 100)) AS cov FROM c GROUP BY ALL),
w AS (SELECT station, count(*) AS sessions, 100.0::DOUBLE * count(first_fault_t) / count(*) AS rate, 100 * sum(CASE WHEN n_faults > 0 THEN {_W} ELSE 0 END) / count(*) AS wt FROM lab GROUP BY ALL),
j AS (SELECT *, greatest(0, coalesce(worst, rate) - rate) AS ex FROM w JOIN cc USING (station))
SELECT station, sessions, CAST(round(10 * round(0.55 * greatest(0, least(100, 100 - 2 * rate)) + 0.3 * greatest(0, least(100, 100 - 2.5 * wt)) + 0.15 * greatest(0, least(100, 100 - 2 * ex)), 1)) AS BIGINT) AS score_tenths FROM j""")
def r11(s, d):
    return R.station_health(labels(s, d)).select("station", "sessions", F.round(F.col("score") * 10).cast("bigint").alias("score_tenths"))


@query("r12_natural_order", f"WITH {O.TEL} SELECT station, CAST(row_number() OVER (ORDER BY CAST(substr(station, 3) AS INT)) AS INT) AS place FROM (SELECT DISTINCT station FROM tel)")
def r12(s, d):
    from ..sources import telemetry as T

    return T.fixture(s, d).select("station").distinct().withColumn("place", F.row_number().over(Window.orderBy(*R.natural_order()))).select("station", "place")


@query("r13_distribution", f"WITH {O.SES}, {O.LABELS} SELECT family, count(*) AS n, count(DISTINCT station) AS stations FROM ff GROUP BY ALL")
def r13(s, d):
    return G.strict_faults(evidence(s, d)).groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("station").alias("stations"))


@query("r14_fleet", f"WITH {O.SES}, {O.LABELS} SELECT station, count(*) AS n, count(first_fault_t) AS faulty, CAST(round(avg(CAST(reached_current_demand AS INT)) * 1e6) AS BIGINT) AS delivered_us, CAST(round(avg(CAST(graceful_close AS INT)) * 1e6) AS BIGINT) AS graceful_us, CAST(round(median((t_end - t_start) / 60) * 1e6) AS BIGINT) AS median_min_us FROM lab GROUP BY ALL")
def r14(s, d):
    return R.fleet(labels(s, d)).select("station", "n", "faulty", *micros("delivered", "graceful", "median_min"))


@query("r15_connector_skew", f"WITH {O.SES}, {O.LABELS}, c AS (SELECT station, connector, count(*) AS n, 100.0::DOUBLE * count(first_fault_t) / count(*) AS rate FROM lab GROUP BY ALL), p AS (SELECT a.station, a.rate AS ra, b.rate AS rb FROM c a JOIN c b ON a.station = b.station AND a.connector = 'connector1' AND b.connector = 'connector2' WHERE a.n >= 30 AND b.n >= 30) SELECT station, CAST(round(ra * 1e6) AS BIGINT) AS connector1_rate_us, CAST(round(rb * 1e6) AS BIGINT) AS connector2_rate_us FROM p WHERE greatest(ra, rb) >= 5 AND abs(ra - rb) >= 5")
def r15(s, d):
    return R.connector_skew(labels(s, d)).select("station", *micros("connector1_rate", "connector2_rate"))


_BUCKET = "CASE WHEN detector = 'Spec' THEN CASE guess WHEN 'PROTOCOL_FAILED' THEN 'baseline rule: ResponseCode' END END"


_SPEC_BUCKET = """CASE WHEN resp_code <> '' THEN 'baseline rule: ResponseCode' WHEN evse_status <> '' THEN 'baseline rule: EVSE status' WHEN isolation = 'Fault' THEN 'baseline rule: isolation' WHEN ev_err <> '' THEN 'baseline rule: EV error'
  WHEN cablecheck_elapsed > 40 THEN 'baseline rule: cablecheck 40s' WHEN phase = 'delivery' AND dt_v2g > 3.5 THEN 'baseline rule: dialog gap' WHEN v_over THEN 'baseline rule: electrical' ELSE 'baseline rule: PLC/SLAC/TCP' END"""
_CONF_BUCKET = """CASE WHEN resp_code <> '' OR evse_status <> '' OR isolation = 'Fault' OR ev_err <> '' THEN 'ISO response/status semantics' WHEN ongoing_s >= 55 THEN 'ISO Ongoing timer [V2G2-711/713]' WHEN seq_gap_s >= 60 THEN 'ISO sequence timer [V2G2-443]'
  WHEN comm_setup_s >= 20 THEN 'ISO comm setup [V2G2-448]' WHEN cablecheck_open AND cablecheck_s >= 40 THEN 'ISO CableCheck [V2G2-702]' WHEN dialog > 1 THEN 'ISO re-dialog [8.8.1]' ELSE 'ISO message timeout [Table 109]' END"""


def _bucketed(source: str, rule: str, bucket: str, name: str) -> str:
    return f"SELECT {K3}, '{name}' AS detector, arg_min(b, (t, seq)) AS bucket FROM (SELECT *, {rule} AS g, {bucket} AS b FROM {source}) WHERE g IS NOT NULL GROUP BY ALL"


@query("r16_attribution", f"WITH {O.SCORED}, rb AS ({_bucketed('trk', O.SPEC, _SPEC_BUCKET, 'Spec')} UNION ALL {_bucketed('conf', O.CONFR, _CONF_BUCKET, 'Conformance')}) SELECT detector, bucket, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("tp", "late", "fp")) + f" FROM sc JOIN rb USING ({K3}, detector) GROUP BY ALL")
def r16(s, d):
    return R.attribution(outcomes(s, d))


@query("r24_latency_evidence", f"""WITH {O.SCORED}, x AS (SELECT msg, n_faults > 0 AS faulty, req_res_latency AS l, {O.LIMIT.format('base')} AS lim FROM trk JOIN lab USING ({K3}) WHERE req_res_latency IS NOT NULL),
g AS (SELECT msg, faulty, count(*) AS n, list_sort(list(l)) AS ls, max(l) AS most, count(*) FILTER (l > lim) AS o FROM x GROUP BY ALL)
SELECT msg, faulty, n, CAST(round(ls[CAST(round_even((n - 1) * 0.5, 0) AS INT) + 1] * 1e6) AS BIGINT) AS p50_us, CAST(round(ls[CAST(round_even((n - 1) * 0.99, 0) AS INT) + 1] * 1e6) AS BIGINT) AS p99_us, CAST(round(most * 1e6) AS BIGINT) AS most_us, CAST(round(100 * o / n * 1e6) AS BIGINT) AS over_us FROM g""")
def r24(s, d):
    rows = X.latency(sessions(s, d))
    return R.latency_evidence(rows, labels(s, d)).select("msg", "faulty", "n", *micros("p50", "p99", "most", "over"))


_CSQL = {
    "Ongoing 60 s": "ongoing_s >= 60", "sequence 60 s": "seq_gap_s >= 60", "setup 20 s": "comm_setup_s >= 20", "cable check 40 s": "cablecheck_open AND cablecheck_s >= 40", "pre-charge 7 s": "precharge_s >= 7", "message timeout": "msg_timeout_ratio >= 1",
    "illegal successor": "seq_illegal", "dialog reopened": "dialog >= 2", "response failed": "resp_code <> ''", "EVSE status": "evse_status <> ''", "isolation fault": "isolation = 'Fault'", "EV error": "ev_err <> ''",
}
_CRIT = " UNION ALL ".join(f"SELECT '{n}' AS criterion, {K3} FROM conf GROUP BY ALL HAVING bool_or({c})" for n, c in _CSQL.items())
_HITS = f"h0 AS ({_CRIT}), h AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT 'any', {K3} FROM h0 UNION ALL SELECT DISTINCT 'new only', {K3} FROM h0 WHERE criterion IN ({', '.join(repr(c) for c in R.NEW_CRITERIA)}))"


@query("r25_criterion_audit", f"WITH {O.SCORED}, {_HITS} SELECT criterion, count(*) AS n, count(first_fault_t) AS on_faulty, count(*) - count(first_fault_t) AS on_clean FROM h JOIN lab USING ({K3}) GROUP BY ALL")
def r25(s, d):
    return R.criterion_audit(conformance(s, d), labels(s, d))


@query("r25_unmet_by_family", f"WITH {O.SCORED}, {_HITS} SELECT first_fault_family AS family, count(*) AS n FROM lab ANTI JOIN h USING ({K3}) WHERE first_fault_t IS NOT NULL GROUP BY ALL")
def r25_unmet(s, d):
    return R.unmet_by_family(conformance(s, d), labels(s, d))


@query("r23_abort_audit", f"WITH {O.SCORED}, m AS (SELECT {K3}, max(msg_timeout_ratio) AS a, max(seq_gap_s) AS b, max(ongoing_s) AS c, max(dialog) AS d, bool_or(msg = 'RST') AS e FROM conf GROUP BY ALL) SELECT {K3}, concat_ws(',', CASE WHEN a >= 1 THEN 'unanswered' END, CASE WHEN b >= 60 THEN 'idle' END, CASE WHEN c >= 60 THEN 'ongoing' END, CASE WHEN d > 1 THEN 'redialog' END, CASE WHEN e THEN 'rst' END) AS tags FROM lab JOIN m USING ({K3}) WHERE first_fault_family = 'SESSION_ABORT'")
def r23(s, d):
    return R.abort_audit(conformance(s, d), labels(s, d)).select(*Z.SESSION, F.concat_ws(",", "tags").alias("tags"))


@query("r22_transitions", f"WITH {O.SES}, {O.LABELS}, leg AS (SELECT {K3}, t_end AS t, 'SESSION_ABORT' AS family FROM rest WHERE ({K3}) NOT IN (SELECT ({K3}) FROM reset)), c2 AS (SELECT * FROM cand WHERE ({K3}, family) NOT IN (SELECT ({K3}, family) FROM evid) UNION ALL FROM leg), f2 AS (SELECT {K3}, arg_min(family, (t, family)) AS fam FROM (SELECT {K3}, family, min(t) AS t FROM c2 GROUP BY ALL) GROUP BY ALL) SELECT coalesce(first_fault_family, 'clean') AS before, coalesce(fam, 'clean') AS after, count(*) AS n FROM lab LEFT JOIN f2 USING ({K3}) GROUP BY ALL")
def r22(s, d):
    rows = sessions(s, d)
    return R.transitions(G.label_sessions(rows), G.label_sessions(rows, "legacy"))


_W15 = ", ".join(f"({w}::DOUBLE)" for w in R.WAITS)
_SWEEP = f"sw AS (SELECT w AS wait, {K3}, min(t) AS t FROM mat, (VALUES {_W15}) x(w) WHERE match_pending AND NOT v2g_seen AND match_pending_s >= w GROUP BY ALL)"


def sweep(s, d) -> DataFrame:
    trace = X.matching(sessions(s, d)).where("match_pending AND NOT v2g_seen").select(*Z.SESSION, F.col("match_pending_s").alias("age_s"), "t")
    return R.wait_sweep(trace)


@query("r27_wait_sweep", f"WITH {O.MATCH}, {_SWEEP} SELECT wait, {K3}, CAST(round(t * 1e6) AS BIGINT) AS t_us FROM sw")
def r27(s, d):
    return sweep(s, d).select("wait", *Z.SESSION, *micros("t"))


@query("r27_wait_scores", f"WITH {O.SCORED}, {O.MATCH.replace(O.SES + ',', '', 1)}, {_SWEEP}, j AS (SELECT w AS wait, l.*, least(a.t, f.t) AS alert_t FROM lab l CROSS JOIN (VALUES {_W15}) x(w) LEFT JOIN (SELECT * FROM al WHERE detector = 'Spec') a USING ({K3}) LEFT JOIN sw f ON f.wait = w AND f.station = l.station AND f.connector = l.connector AND f.sid = l.sid), k AS (SELECT *, {O.OUTCOME.replace('a.t', 'alert_t')} AS outcome, CASE WHEN first_fault_t IS NOT NULL AND alert_t <= first_fault_t + 10 THEN greatest(0, first_fault_t - alert_t) END AS lead FROM j), g AS (SELECT wait, {_METRICS} FROM k GROUP BY wait), h AS (SELECT *, {_RATES} FROM g) SELECT wait, {_OUT} FROM h")
def r27_scores(s, d):
    spec = alerts(s, d, ["Spec"]).select(*Z.SESSION, "t")
    return board(R.wait_scores(labels(s, d), spec, sweep(s, d)), "wait")


@query("r26_projection", f"WITH {O.SCORED}, f AS ({O.alerts('conf', O.CONFR, 'x')}) SELECT {K3}, 'Spec' AS detector, CAST(round(least(a.t, f.t) * 1e6) AS BIGINT) AS t_us FROM (SELECT * FROM al WHERE detector = 'Spec') a FULL JOIN f USING ({K3})")
def r26(s, d):
    a = alerts(s, d, ["Spec"])
    return R.projected(a, alerts(s, d, ["Conformance"]).select(*Z.SESSION, "t"), ["Spec"]).select(*Z.SESSION, "detector", *micros("t"))


@query("r31_fault_share", f"WITH {O.SES}, {O.LABELS}, g AS (SELECT family, count(*) AS n FROM ff GROUP BY 1) SELECT family, n, CAST(round(n / sum(n) OVER () * 1e6) AS BIGINT) AS share_us FROM g")
def r31(s, d):
    g = G.strict_faults(evidence(s, d)).groupBy("family").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).select("family", "n", *micros("share"))


_P = ("spec", "conformance", "comm", "trend", "link")


# all features of a row in one table, under the names of the Spark columns
_TOOLS = f"""WITH {O.FULL}, {O.CONF.replace(O.TRACK + ",", "", 1)}, {O.MATCH.replace(O.SES + ",", "", 1)},
ci AS (SELECT *, {O.run("sum(CASE WHEN evse_i IS NOT NULL AND NOT i_collapse THEN 1 ELSE 0 END)")} AS isl FROM full_trk),
cr AS (SELECT *, CASE WHEN evse_i IS NOT NULL THEN {O.run("sum(CASE WHEN evse_i IS NOT NULL AND i_collapse THEN 1 ELSE 0 END)", ", isl")} END AS collapse_run FROM ci),
tl AS (SELECT f.*, c.ongoing_s / 60 AS ongoing_ratio, c.seq_gap_s / 60 AS seq_timeout_ratio, c.cablecheck_s / 40 AS cablecheck_ratio, c.precharge_s / 7 AS precharge_ratio, c.precharge_v_gap_ratio, c.msg_timeout_ratio,
  c.comm_setup_s / 20 AS setup, greatest(c.dialog - 1, 0) AS again, c.seq_illegal, m.v2g_seen, m.match_pending, m.match_pending_s, m.n_restart, phase = 'delivery' AS del, phase IN ('cablecheck', 'precharge', 'delivery') AS busy,
  kind = 'v2g' AND (evse_v IS NOT NULL OR evse_i IS NOT NULL) AS trend, kind IN ('tcp', 'hpav') OR phase = 'delivery' AS link, f.t - min(f.t) OVER (PARTITION BY f.station, f.connector, f.sid) AS t0
  FROM cr f JOIN (SELECT seq, ongoing_s, seq_gap_s, cablecheck_s, precharge_s, precharge_v_gap_ratio, msg_timeout_ratio, comm_setup_s, dialog, seq_illegal FROM conf) c USING (seq) JOIN (SELECT seq, v2g_seen, match_pending, match_pending_s, n_restart FROM mat) m USING (seq))"""


def _strongest(*rules: tuple[str, str]) -> str:
    return f"greatest({', '.join(f'CASE WHEN {when} THEN {weight} END' for when, weight in rules)}, NULL)"


_POSTS = {
    "protocol": _strongest(("resp_code <> ''", "1.0"), ("validation = 'FAIL'", "0.3"), ("del AND notification IN ('Stop', 'StopCharging')", "0.35"), ("setup > 0.5", "least(0.2 + 0.7 * setup, 0.9)"), ("seq_illegal", "0.7"), ("again > 0", "least(0.6 + 0.2 * again, 0.9)")),
    "evse": _strongest(("evse_status <> ''", "1.0")),
    "isolation": _strongest(("isolation = 'Fault'", "1.0"), ("isolation = 'Warning'", "0.55")),
    "ev": _strongest(("ev_err <> ''", "1.0")),
    "timeout": _strongest(("cablecheck_elapsed > 30", "CASE WHEN cablecheck_elapsed < 40 THEN 0.5 ELSE 0.9 END"), ("precharge_elapsed > 7", "0.6"), ("ongoing_ratio > 0.25", "least(0.3 + 0.7 * ongoing_ratio, 0.97)"),
        ("seq_timeout_ratio > 0.25", "least(0.2 + 0.8 * seq_timeout_ratio, 0.95)"), ("cablecheck_ratio > 0.6", "least(0.3 + 0.6 * cablecheck_ratio, 0.92)"), ("msg_timeout_ratio >= 1", "0.8")),
    "power": _strongest(("trend AND v_over", "0.9"), ("trend AND collapse_run >= 60", "0.6"), ("trend AND (abs(v_ripple_z) > 8 OR abs(i_ripple_z) > 8)", "0.25"), ("precharge_ratio > 0.7 AND precharge_v_gap_ratio > 1", "least(0.3 + 0.4 * precharge_ratio, 0.85)")),
    "comm": _strongest(("link AND retx_60s > 12", "least(0.1 + 0.015 * retx_60s, 0.6)"), ("link AND link_gap > 2 AND phase <> 'idle'", "least(0.4 + 0.1 * link_gap, 0.9)"), ("link AND slac_attempts >= 2", "0.5 + 0.2 * least(slac_attempts - 2, 2)"),
        ("link AND rst_seen AND busy", "0.8"), ("del AND dt_v2g > 1.5", "least(0.2 + 0.15 * dt_v2g, 0.8)"), ("link AND latency_z > 6 AND req_res_latency > 0.1", "0.35"),
        ("NOT v2g_seen", "CASE WHEN match_pending AND match_pending_s >= 10 THEN 0.96 WHEN match_pending_s >= 1 THEN 0.45 END"), ("NOT v2g_seen AND n_restart >= 1", "0.5 + 0.15 * least(n_restart, 3)")),
    "battery": _strongest(("trend AND remaining_trend > 5", "0.3"), ("trend AND del AND soc_rate <= 0 AND evse_i > 30 AND session_elapsed > 120", "0.45")),
}
_SO_FAR = f"OVER (PARTITION BY {K3} {O.O} ROWS UNBOUNDED PRECEDING)"
_KEPT = ", ".join(f"max(CASE WHEN w_{n} > 0 THEN {{'s': log2(w_{n}) + t0 / 20, 't': t0, 'w': w_{n}}} END) {_SO_FAR} AS p_{n}" for n in _POSTS)
_NOW = ", ".join(f"coalesce(pow(2.0, p_{n}.s - t0 / 20), 0) AS n_{n}" for n in _POSTS)
_BELIEF = "1 - " + " * ".join(f"CASE WHEN n_{n} >= 0.05 THEN 1 - least(n_{n}, 0.99) ELSE 1 END" for n in _POSTS)
_ACTIVE = " + ".join(f"CASE WHEN n_{n} >= 0.05 THEN 1 ELSE 0 END" for n in _POSTS)
_HARD = " OR ".join(f"coalesce(n_{n} >= 0.05 AND p_{n}.w >= 0.95, false)" for n in _POSTS)
_BOARD = f"""w AS (SELECT *, {", ".join(f"CAST({x} AS DOUBLE) AS w_{n}" for n, x in _POSTS.items())} FROM tl), k AS (SELECT *, {_KEPT} FROM w), n AS (SELECT *, {_NOW} FROM k),
bd AS (SELECT *, {_BELIEF} AS belief, {_ACTIVE} AS active, {_HARD} AS hard FROM n)"""


@query("d8_evidence_board", f"{_TOOLS}, {_BOARD} SELECT {K3}, CAST(round(arg_min(t, (t, seq)) * 1e6) AS BIGINT) AS t_us, CAST(round(least(arg_min(belief, (t, seq)), 0.99) * 1e6) AS BIGINT) AS confidence_us FROM bd WHERE hard OR (belief >= 0.85 AND active >= 2) GROUP BY ALL")
def d8(s, d):
    rows = all_tools(s, d)
    return D.first_alerts(D.evidence_board(rows, D.evidence_posts(rows)), "Board").select(*Z.SESSION, *micros("t", "confidence"))


@query("d9_evidence_posts", f"{_TOOLS}, {_BOARD} SELECT seq, " + ", ".join(f"CAST(round(w_{n} * 1e6) AS BIGINT) AS {n}_us" for n in _POSTS) + " FROM bd")
def d9(s, d):
    rows = all_tools(s, d)
    return rows.withColumns({f"_w_{n}": w for n, w in D.evidence_posts(rows).items()}).select("seq", *[F.round(F.col(f"_w_{n}") * 1e6).cast("bigint").alias(f"{n}_us") for n in _POSTS])


_LENS = {
    "power": _strongest(("v_over", "0.95"), ("evse_i IS NOT NULL AND collapse_run >= 60", "0.6"), *[(f"abs({x}) > 8", f"least(0.15 + 0.03 * abs({x}), 0.45)") for x in ("v_ripple_z", "i_ripple_z")],
        ("precharge_elapsed > 7", "least(0.4 + 0.05 * precharge_elapsed, 0.85)"), ("precharge_elapsed > 4 AND abs(precharge_v_gap) > 60", "0.55")),
    "battery": _strongest(("ev_err <> ''", "1.0"), ("del AND soc_rate <= 0 AND evse_i > 30 AND session_elapsed > 120", "0.5"), ("remaining_trend > 5", "0.3")),
    "protocol": _strongest(("resp_code <> '' OR evse_status <> '' OR isolation = 'Fault'", "1.0"), ("isolation = 'Warning'", "0.45"), ("validation = 'FAIL'", "0.3"), ("del AND notification IN ('Stop', 'StopCharging')", "0.45"),
        ("cablecheck_elapsed > 25", "least(0.4 + 0.02 * cablecheck_elapsed, 0.9)"), ("del AND dt_v2g > 1.5", "least(0.2 + 0.15 * dt_v2g, 0.8)"), ("latency_z > 5 AND req_res_latency > 0.1", "0.4")),
    "comms": _strongest(("kind = 'hpav' AND contains(msg, 'SLAC_PARM.REQ') AND slac_attempts >= 2", "CASE WHEN v2g_seen THEN 0.95::DOUBLE ELSE least(0.3 + 0.1 * slac_attempts, 0.6) END"), ("link_gap > 1.5 AND phase <> 'idle'", "least(0.35 + 0.15 * link_gap, 0.9)"),
        ("retx_60s > 12", "least(0.1 + 0.015 * retx_60s, 0.6)"), ("rst_seen AND busy", "0.75"), ("NOT v2g_seen AND match_pending AND match_pending_s >= 10", "0.95")),
    "standards": _strongest(("resp_code <> '' OR evse_status <> ''", "1.0"), ("ongoing_ratio > 0.25", "least(0.3 + 0.7 * least(ongoing_ratio, 1), 0.97)"), ("seq_timeout_ratio > 0.25", "least(0.2 + 0.8 * least(seq_timeout_ratio, 1), 0.95)"),
        ("cablecheck_ratio > 0.6", "least(0.3 + 0.6 * least(cablecheck_ratio, 1), 0.92)"), ("setup > 0.5", "least(0.2 + 0.7 * least(setup, 1), 0.9)"), ("again > 0", "least(0.6 + 0.2 * again, 0.9)"), ("seq_illegal", "0.7"), ("msg_timeout_ratio >= 1", "0.8")),
}


# no weight is above 1; a decayed weight is never above a weight at its own row, so a session's greatest suspicion is its greatest weight
@query("d10_lens_suspicions", f"{_TOOLS} SELECT {K3}, " + ", ".join(f"coalesce(round(max(CAST({x} AS DOUBLE)), 6), 0) AS {n}" for n, x in _LENS.items()) + " FROM tl GROUP BY ALL")
def d10(s, d):
    rows = D.lens_suspicions(all_tools(s, d))
    return rows.groupBy(*Z.SESSION).agg(*[F.round(F.max(f"suspicion_{n}"), 6).alias(n) for n in D.LENSES])


_CONFIDENCE = """CASE WHEN resp_code <> '' OR evse_status <> '' OR isolation = 'Fault' OR ev_err <> '' THEN 1.0 WHEN cablecheck_elapsed > 40 THEN 0.9 WHEN phase = 'delivery' AND dt_v2g > 3.5 THEN 0.85 WHEN v_over THEN 0.9
  WHEN retx_60s > 60 THEN 0.7 WHEN link_gap > 3 AND phase <> 'idle' THEN 0.75 WHEN slac_attempts >= 3 THEN 0.8 WHEN rst_seen AND phase IN ('delivery', 'cablecheck', 'precharge') THEN 0.8 END"""


@query("b16_severity", f"WITH {O.TRACK}, a AS (SELECT {K3}, arg_min(c, (t, seq)) AS c FROM (SELECT *, {_CONFIDENCE} AS c FROM trk) WHERE c IS NOT NULL GROUP BY ALL) SELECT CASE WHEN c >= 0.95 THEN 'critical' WHEN c >= 0.85 THEN 'high' WHEN c >= 0.7 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM a GROUP BY ALL")
def b16(s, d):
    return D.first_alerts(D.spec_rules(tracked(s, d)), "Spec").groupBy(S.severity_for(F.col("confidence")).alias("severity")).agg(F.count("*").alias("n"))
