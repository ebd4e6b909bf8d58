"""What a capture shows: who stopped a session, the verdict over a capture's sessions, and findings worth telling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from .sessions import SESSION

DETAILS = 500  # fixed value: session rows that a verdict lists
CHARGING = K.DC_STAGES[: K.DC_STAGES.index("CurrentDemand") + 1]


def _v2g() -> Column:
    return F.col("kind") == "v2g"


def _earliest(condition: Column, *columns: str) -> Column:
    return F.min(F.when(condition, F.struct("t", "seq", *columns)))


def stop_attribution(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per session: triggered_by, request_sender, confidence, evidence (fixed values: their order and texts).

    The first that holds decides: no dialog; the charger's own marker; isolation; the vehicle's own marker; a failed
    response; no setup response; no further request; processing that did not end; a reset; the link; a stop request.
    ``alerts`` has one row per session at most, with fault_guess and reason. Sessions without an alert count as
    without family and reason; null text counts as empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hard = F.col("evse_status").isin("EVSE_Malfunction", "EVSE_EmergencyShutdown")
    charger = F.lower(text("notification")).isin("stopcharging", "terminate") | hard
    error = F.upper(text("ev_err"))
    progress = F.coalesce(S.extra_get(F.col("extra"), "ChargeProgress"), F.lit(""))
    vehicle = S.truthy(F.col("charge_complete")) | ~error.isin("", "NO_ERROR", "NODATA") | (F.lower(progress) == "stop")
    rows = rows.withColumns({"_progress": progress, "_complete": S.truthy(F.col("charge_complete"))})
    marks = rows.groupBy(*SESSION).agg(
        F.coalesce(F.bool_or(_v2g() & (F.col("msg") == "SessionStopReq")), F.lit(False)).alias("asked"),
        F.bool_or(_v2g()).alias("talks"), F.bool_or(F.col("kind") == "hpav").alias("linked"), F.bool_or((F.col("kind") == "tcp") & (F.col("msg") == "RST")).alias("reset"),
        _earliest(_v2g() & charger, "evse_status", "notification").alias("charger"), _earliest(_v2g() & vehicle, "ev_err", "_complete", "_progress").alias("vehicle"),
        _earliest(_v2g() & S.is_failed(F.col("resp_code")), "msg", "resp_code").alias("failed"),
    )
    told = alerts.select(*SESSION, F.upper(text("fault_guess")).alias("family"), text("reason").alias("reason"))
    m = marks.join(told, list(SESSION), "left").fillna("", ["family", "reason"])
    c, say = F.col, F.lit
    sender = F.when(c("asked"), "vehicle")

    def verdict(by: str, confidence, evidence: Column, who: Column = sender) -> Column:
        confidence = confidence if isinstance(confidence, Column) else say(confidence)
        return F.struct(say(by).alias("triggered_by"), who.alias("request_sender"), confidence.alias("confidence"), evidence.alias("evidence"))

    frozen = c("family").isin("COMM_FREEZE", "SESSION_ABORT")
    marker = F.when(c("vehicle.ev_err") != "", c("vehicle.ev_err")).when(c("vehicle._complete"), "ChargingComplete=TRUE").otherwise(F.concat(say("ChargeProgress="), "vehicle._progress"))
    broken = (c("family") == "PROTOCOL_FAILED") & c("failed").isNotNull()
    closing = (c("failed.msg") == "SessionStopRes") & c("asked")
    answer = F.concat_ws(":", F.when(c("failed.msg") != "", c("failed.msg")).otherwise("response"), "failed.resp_code")
    nobody = say(None).cast("string")
    out = (
        F.when((c("family") == "SLAC_FAILURE") | (~c("talks") & c("linked")), verdict("not_applicable", "high", say("SLAC/PLC matching did not establish a V2G charging session."), nobody))
        .when(c("charger").isNotNull(), verdict("charger", "high", F.concat(say("EVSE reported "), F.when(c("charger.evse_status") != "", c("charger.evse_status")).otherwise(c("charger.notification")), say(" before or during session close."))))
        .when(c("family") == "ISOLATION_FAULT", verdict("charger", "high", say("EVSE reported EVSEIsolationStatus=Fault and inhibited power for safety.")))
        .when(c("vehicle").isNotNull(), verdict("vehicle", F.when(c("vehicle.ev_err") != "", "high").otherwise("medium"), F.concat(say("EV/EVCC reported "), marker, say("."))))
        .when(broken & closing, verdict("vehicle", "high", F.concat(say("EV sent SessionStopReq; EVSE then returned "), answer, say("."))))
        .when(broken, verdict("charger", "high", F.concat(say("EVSE returned "), answer, say("."))))
        .when(c("reason").contains("no SessionSetupRes"), verdict("charger", "medium", say("EV sent session setup traffic but no SessionSetupRes was observed from the EVSE.")))
        .when(frozen & c("reason").contains("no further request"), verdict("vehicle", "medium", say("The EV sent no next request before the protocol timeout.")))
        .when(frozen & (c("reason").contains("EVSEProcessing") | c("reason").contains("CableCheck")), verdict("charger", "medium", say("EVSE processing did not complete before the applicable phase timeout.")))
        .when(c("reset"), verdict("unknown", "low", say("TCP RST was observed, but the extractor does not retain endpoint direction.")))
        .when(F.lower("reason").contains("re-slac") | F.lower("reason").contains("link"), verdict("communication", "medium", say("PLC/V2G link degradation was observed; the failing endpoint is not identifiable.")))
        .when(c("asked"), verdict("vehicle", "medium", say("SessionStopReq from the EV was observed with no earlier EVSE stop marker in the capture.")))
        .otherwise(verdict("unknown", "low", say("The available packet fields do not identify which side initiated the stop."), nobody))
    )
    return m.select(*SESSION, out.alias("v")).select(*SESSION, "v.*")


def capture_sessions(rows: DataFrame, alerts: DataFrame, *capture: str) -> DataFrame:
    """One row per session of each capture: place (in time), bounds, rows, first and last message, graceful, first alert."""
    spoken = _v2g() & (F.col("msg") != "")
    graceful = _v2g() & (F.col("msg") == "SessionStopRes") & ~S.is_failed(F.col("resp_code"))
    s = rows.groupBy(*dict.fromkeys([*capture, *SESSION])).agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_events"), F.bool_or(graceful).alias("graceful"),
        F.min(F.when(spoken, F.struct("t", "seq", "msg"))).alias("_f"), F.max(F.when(spoken, F.struct("t", "seq", "msg"))).alias("_l"),
    )
    a = alerts.select(*SESSION, F.struct(F.col("t").alias("t"), "confidence", "reason", "fault_guess").alias("alert"))
    place = F.row_number().over(Window.partitionBy(*capture).orderBy("t_start", *SESSION))
    return s.join(a, list(SESSION), "left").select("*", F.col("_f.msg").alias("first_msg"), F.col("_l.msg").alias("last_msg"), place.alias("place")).drop("_f", "_l")


def capture_verdicts(captures: DataFrame, sessions: DataFrame, *capture: str, details: int = DETAILS) -> DataFrame:
    """One row per capture (capture, n_events): status, fault family, confidence, severity, counts and warning codes.

    The earliest alert of any session decides (of equals the first session); else it is inconclusive without sessions
    or with one that did not close, else no fault was detected. ``n_details`` sessions are listed, all were evaluated.
    """
    s = sessions.groupBy(*capture).agg(
        F.count("*").alias("n_sessions"), F.count_if("graceful").alias("n_complete"), F.count("alert").alias("n_alerted"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"),
        F.min(F.when(F.col("alert").isNotNull(), F.struct("alert.t", "place", "alert"))).alias("_a"), F.max(F.when(F.col("place") == 1, F.col("first_msg"))).alias("_first"),
    )
    j = captures.join(s, list(capture), "left").fillna(0, ["n_sessions", "n_complete", "n_alerted"])
    c = F.col
    alerted, none = c("_a").isNotNull(), c("n_sessions") == 0
    short = c("n_complete") < c("n_sessions")
    status = F.when(alerted, "fault_detected").when(none | short, "inconclusive").otherwise("no_fault_detected")
    confidence = F.least(F.greatest(c("_a.alert.confidence"), F.lit(0.0)), F.lit(1.0))
    warnings = F.array_compact(F.array(
        F.when(c("n_events") == 0, "no_supported_events"),
        F.when(c("_first").isNotNull() & ~c("_first").isin(*K.OPENERS), "capture_starts_mid_session"),
        F.when((c("n_events") > 0) & none, "no_sessions"),
        F.when(short, "incomplete_session"),
        F.when(c("n_sessions") > details, "session_details_truncated"),
        F.when(status == "no_fault_detected", "no_alert_not_health_proof"),
    ))
    return j.select(*captures.columns, status.alias("status"), c("_a.alert.fault_guess").alias("fault_family"), confidence.alias("confidence"), F.when(alerted, S.severity_for(confidence)).alias("severity"), c("_a.alert.reason").alias("reason"), "n_sessions", "n_complete", "n_alerted", F.least("n_sessions", F.lit(details)).alias("n_details"), "t_start", "t_end", warnings.alias("warnings"))


def capture_details(sessions: DataFrame, details: int = DETAILS) -> DataFrame:
    """The sessions that a verdict lists: the first ``details`` of each capture."""
    return sessions.where(F.col("place") <= details)


def observations(rows: DataFrame) -> DataFrame:
    """(session, code, args): findings worth telling, faults or not, of sessions with a dialog (fixed values: codes and limits).

    no_current_demand, silent_after, isolation_invalid, cablecheck_long, precharge_short, slac_slow. Numbers in
    ``args`` are text with one decimal.
    """
    c, base = F.col, S.msg_base(F.col("msg"))
    stage = F.when(_v2g() & base.isin(*CHARGING), S.stage_index(c("msg")))
    named = lambda name: _v2g() & c("msg").startswith(name)
    slac = (c("kind") == "hpav") & (c("msg").contains("SLAC") | c("msg").contains("ATTEN_CHAR"))
    last_of = lambda when, value: F.max(F.when(when & c(value).isNotNull() & (c(value) != 0), F.struct("t", "seq", value))).getField(value)
    rows = rows.withColumn("_last_v2g", F.max(F.when(_v2g(), c("t"))).over(Window.partitionBy(*SESSION)))
    m = rows.groupBy(*SESSION).agg(
        F.count_if(_v2g()).alias("n_v2g"), F.max("t").alias("t_end"), F.min(F.when(_v2g(), c("t"))).alias("first_v2g"), F.max(F.when(_v2g(), F.struct("t", "seq", base.alias("base")))).alias("last"),
        F.max(stage).alias("reached"), F.bool_or(named("CurrentDemand")).alias("delivered"), F.count_if(c("t") > c("_last_v2g")).alias("after"),
        F.count_if(named("CableCheck") & (c("isolation") != "")).alias("n_iso"), F.count_if(named("CableCheck") & ~c("isolation").isin("", "Valid")).alias("bad_iso"),
        F.min(F.when(named("CableCheck"), c("t"))).alias("c0"), F.max(F.when(named("CableCheck"), c("t"))).alias("c1"), F.count_if(_v2g() & (c("msg") == "CableCheckReq")).alias("n_cable"),
        last_of(named("PreCharge"), "ev_target_v").alias("target"), last_of(named("PreCharge"), "evse_v").alias("volts"), F.min(F.when(slac, c("t"))).alias("s0"),
    ).where("n_v2g > 0")
    one = lambda x: F.format_string("%.1f", F.round(x, 1))
    whole = lambda x: x.cast("string")
    phase = F.when(c("reached").isNull(), "?").otherwise(F.get(F.array(*[F.lit(p) for p in K.DC_STAGES]), c("reached")))
    quiet, cable, short, pair = c("t_end") - c("last.t"), c("c1") - c("c0"), c("target") - c("volts"), c("first_v2g") - c("s0")
    say = lambda when, code, *args: F.when(when, F.struct(F.lit(code).alias("code"), F.array(*args).alias("args")))
    found = F.array_compact(F.array(
        say(~F.coalesce(c("delivered"), F.lit(False)), "no_current_demand", phase),
        say((quiet >= 10) & (c("last.base") != "SessionStop"), "silent_after", c("last.base"), one(quiet), whole(c("after"))),
        say(c("bad_iso") > 0, "isolation_invalid", whole(c("bad_iso")), whole(c("n_iso"))),
        say(cable > 10, "cablecheck_long", one(cable), whole(c("n_cable"))),
        say(short > 5, "precharge_short", one(c("volts")), one(c("target")), one(short)),
        say(pair > 20, "slac_slow", one(pair)),
    ))
    return m.select(*SESSION, F.explode(found).alias("o")).select(*SESSION, "o.code", "o.args")
