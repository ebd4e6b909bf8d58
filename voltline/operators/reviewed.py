"""The reviewed label profile: the standard's own timers, each admitted only where the capture provably went on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from . import labels as G
from .features import v2g
from .sessions import SESSION, UP_TO, count_so_far, last_before, per


def _join(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def proven(rows: DataFrame, candidates: DataFrame, least_rows: int, most_gap_s: float) -> DataFrame:
    """Candidates (session, t, family, detail, a, b) whose interval [a, b] is continuous."""
    return G.continuous(rows, candidates, least_rows, most_gap_s).select(*SESSION, "t", "family", "detail")


def _candidate(df: DataFrame, t, family: str, detail, a, b) -> DataFrame:
    return df.select(*SESSION, t.alias("t"), F.lit(family).alias("family"), detail.alias("detail"), a.alias("a"), b.alias("b"))


def timer_faults(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Requests answered or left beyond max(2 x limit, 1.5 s), 60 s without a request, 60 s of Ongoing in one response."""
    v = G.with_facts(rows.where(v2g()), facts, "t_end").withColumn("_x", S.msg_suffix(F.col("msg"))).withColumn("_base", S.msg_base(F.col("msg")))
    req, res = F.col("_x") == "Req", F.col("_x") == "Res"
    sent = F.last(F.when(req, F.col("t")).when(res, F.lit(-1.0)), True).over(per(*SESSION, "_base").rowsBetween(*UP_TO))
    before = F.last(F.when(req, F.col("t")).when(res, F.lit(-1.0)), True).over(per(*SESSION, "_base").rowsBetween(*(UP_TO[0], -1)))
    v = v.withColumn("_sent", before).withColumn("_open", sent).withColumn("_since", last_before(F.when(req, F.lit(-1.0)).when(res, F.col("t")), *SESSION))
    limits = K.lookup({k[:-3]: s for k, s in K.MSG_TIMEOUT_S.items()}, F.col("_base"))
    v = v.withColumn("_limit", limits).withColumn("_margin", F.greatest(2 * F.col("_limit"), F.lit(1.5)))
    own = (F.col("_base").isin("CableCheck", "ChargeParameterDiscovery")) & res
    v = v.withColumn("_ends", count_so_far(own & (F.col("evse_processing") == "Finished"), *SESSION, "_base"))
    # the row that says Finished still belongs to the wait that it ends
    v = v.withColumn("_wait", F.col("_ends") - F.when(own & (F.col("evse_processing") == "Finished"), 1).otherwise(0))
    v = v.withColumn("_o", F.min(F.when(own & (F.col("evse_processing") == "Ongoing"), F.col("t"))).over(per(*SESSION, "_base", "_wait").rowsBetween(*UP_TO)))
    lat = F.col("t") - F.col("_sent")
    late = _candidate(v.where(res & (F.col("_sent") >= 0) & (lat >= F.col("_margin"))), F.col("_sent") + F.col("_limit"), "COMM_FREEZE", F.format_string("%sReq unanswered for %.2fs", F.col("_base"), lat), F.col("_sent"), F.col("t"))
    gap = F.col("t") - F.col("_since")
    idle = _candidate(v.where(req & ~F.col("msg").isin(*K.OPENERS) & (F.col("_since") >= 0) & (gap >= K.SEQ_TIMEOUT_S)), F.col("_since") + K.SEQ_TIMEOUT_S, "COMM_FREEZE", F.format_string("no next request for %.1fs [V2G2-443 SECC sequence timeout]", gap), F.col("_since"), F.col("_since") + K.SEQ_TIMEOUT_S)
    span = F.col("t") - F.col("_o")
    slow = _candidate(v.where(own & (F.col("evse_processing") == "Finished") & (span >= K.ONGOING_TIMEOUT_S)), F.col("_o") + K.ONGOING_TIMEOUT_S, "EVSE_PROCESSING_STALL", F.format_string("%s Ongoing for %.1fs [V2G2-711]", F.col("msg"), span), F.col("_o"), F.col("_o") + K.ONGOING_TIMEOUT_S)
    order = F.struct("t", "seq")
    tail = v.where(F.col("_x") != "").groupBy(*SESSION, "_base", "t_end").agg(F.max_by(F.struct("_open", "_limit", "_margin"), order).alias("l"), F.max_by("_ends", order).alias("_e"), F.max_by(F.struct("_o", "_wait"), F.when(own, order)).alias("o"))
    waits = tail.where((F.col("l._open") >= 0) & (F.col("t_end") - F.col("l._open") >= F.col("l._margin")))
    deadline = F.col("l._open") + F.col("l._limit")
    left = _candidate(waits, deadline, "COMM_FREEZE", F.format_string("%sReq unanswered past %ss timeout on live link", F.col("_base"), F.col("l._limit").cast("string")), deadline, F.least("t_end", deadline + G.ALIVE_S))
    stuck = tail.where((F.col("o._wait") == F.col("_e")) & (F.col("t_end") - F.col("o._o") >= K.ONGOING_TIMEOUT_S))
    still = _candidate(stuck, F.col("o._o") + K.ONGOING_TIMEOUT_S, "EVSE_PROCESSING_STALL", F.format_string("%sRes left Ongoing past 60s [V2G2-711]", F.col("_base")), F.col("o._o"), F.col("o._o") + K.ONGOING_TIMEOUT_S)
    end = v.where(F.col("_x") != "").groupBy(*SESSION, "t_end").agg(F.max_by(F.struct("_x", "t"), order).alias("l")).where((F.col("l._x") == "Res") & (F.col("t_end") - F.col("l.t") >= K.SEQ_TIMEOUT_S))
    silent = _candidate(end, F.col("l.t") + K.SEQ_TIMEOUT_S, "COMM_FREEZE", F.lit("no next request for 60s [V2G2-443 SECC sequence timeout]"), F.col("l.t"), F.col("l.t") + K.SEQ_TIMEOUT_S)
    return _join([proven(rows, late.unionByName(left), 10, 1.0), proven(rows, idle.unionByName(silent), 100, 2.0), proven(rows, slow.unionByName(still), 20, 5.0)])


def marker_faults(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Stated faults: the payload of failed rows is ignored, NoData counts once current flows, a second Invalid isolation does."""
    v = G.with_facts(rows.where(v2g()), facts, "first_cd")
    ok, err = ~S.is_failed(F.col("resp_code")), F.upper("ev_err")
    seen = F.col("first_cd").isNotNull() & (F.col("t") >= F.col("first_cd"))
    fault = lambda when, family, detail: F.when(when, F.struct(F.lit(family).alias("family"), detail.alias("detail")))
    found = F.array_compact(F.array(
        fault(~ok, "PROTOCOL_FAILED", F.concat_ws(":", "msg", "resp_code")),
        fault(ok & F.col("evse_status").isin("EVSE_Malfunction", "EVSE_EmergencyShutdown"), "EVSE_FAULT", F.concat_ws(":", "msg", "evse_status")),
        fault(ok & (F.col("isolation") == "Fault"), "ISOLATION_FAULT", F.concat("msg", F.lit(":IsolationFault"))),
        fault(ok & ~err.isin("", "NO_ERROR", "NODATA", "RESERVED_A", "RESERVED_B", "RESERVED_C"), "EV_ERROR", F.concat_ws(":", "msg", "ev_err")),
        fault(ok & (err == "NODATA") & seen, "EV_ERROR", F.concat("msg", F.lit(":NoData persisted into delivery"))),
    ))
    stated = v.select(*SESSION, "t", F.explode(found).alias("f")).select(*SESSION, "t", "f.family", "f.detail")
    invalid = v.where(ok & (F.col("isolation") == "Invalid") & seen).withColumn("_n", F.row_number().over(per(*SESSION))).where("_n = 2")
    return stated.unionByName(invalid.select(*SESSION, "t", F.lit("ISOLATION_FAULT").alias("family"), F.lit("Isolation Invalid persisted into CurrentDemand").alias("detail")))


def cable_faults(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Cable check beyond 40 s, from its first request to a successful Finished response or the pre-charge request."""
    done = (F.col("msg") == "PreChargeReq") | ((F.col("msg") == "CableCheckRes") & ~S.is_failed(F.col("resp_code")) & (F.col("evse_processing") == "Finished"))
    ends = G.with_facts(rows.where(v2g() & done), facts.where("cable_req IS NOT NULL"), "cable_req").where("t > cable_req").groupBy(*SESSION).agg(F.min("t").alias("end"))
    spans = facts.where("cable_req IS NOT NULL").select(*SESSION, "cable_req", "last_cable").join(ends, list(SESSION), "left").withColumn("span", F.coalesce("end", "last_cable") - F.col("cable_req"))
    limit = F.col("cable_req") + K.CABLECHECK_TIMEOUT_S
    return proven(rows, _candidate(spans.where(F.col("span") > K.CABLECHECK_TIMEOUT_S), limit, "COMM_FREEZE", F.format_string("CableCheck stuck %.0fs", "span"), F.col("cable_req"), limit), 20, 5.0)


def precharge_faults(rows: DataFrame, facts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Pre-charge beyond 10 s whose voltage gap did not close; not where decoding is in doubt."""
    at = lambda c: F.min(F.when(c, F.col("t")))
    v = rows.where(v2g())
    start = v.groupBy(*SESSION).agg(at(F.col("msg") == "PreChargeReq").alias("a")).where("a IS NOT NULL")
    inside = v.join(start, list(SESSION))
    ends = inside.groupBy(*SESSION, "a").agg(at((F.col("t") > F.col("a")) & (F.col("msg") == "PowerDeliveryReq")).alias("p"), F.max(F.when((F.col("t") >= F.col("a")) & F.col("msg").startswith("PreCharge"), F.col("t"))).alias("l"))
    long = ends.where(F.coalesce("p", "l") > F.col("a") + G.PRECHARGE_S).select(*SESSION, "a", (F.col("a") + G.PRECHARGE_S).alias("b"))
    pair = F.abs(F.col("ev_target_v") - F.col("evse_v"))
    measured = v.join(long, list(SESSION)).where(F.col("t").between(F.col("a"), F.col("b")) & pair.isNotNull())
    g = measured.groupBy(*SESSION, "a", "b").agg(F.count("*").alias("n"), F.min_by(pair, F.struct("t", "seq")).alias("first"), F.max_by(pair, F.struct("t", "seq")).alias("last"))
    bad = g.where((F.col("n") >= 2) & (F.col("last") > 20) & (F.col("last") >= 0.5 * F.greatest(F.col("first"), F.lit(1.0)))).join(flagged.select(*SESSION), list(SESSION), "left_anti")
    return proven(rows, _candidate(bad, F.col("b"), "PRECHARGE_FAULT", F.format_string("PreCharge >10s without convergence (gap %.1f->%.1fV)", "first", "last"), F.col("a"), F.col("b")), 10, 2.0)


def unpaired(rows: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faults, censored): sessions without a dialog, by whether the link was this connector's own and 20 s were seen."""
    alone = facts.where("n_v2g = 0")
    linked = F.col("kind").isin("sdp", "tcp") | ((F.col("kind") == "hpav") & (F.col("msg").contains("SLAC_PARM.CNF") | F.col("msg").contains("SLAC_MATCH.CNF") | F.col("msg").contains("ATTEN_CHAR.RSP")))
    own = rows.join(alone.select(*SESSION, "t_end", "t_start", "first_slac"), list(SESSION)).groupBy(*SESSION, "t_end", "t_start", "first_slac").agg(F.bool_or(linked).alias("own"))
    begin = F.coalesce("first_slac", "t_start")
    seen = own.where(F.col("own") & (F.col("t_end") >= begin + K.COMM_SETUP_TIMEOUT_S))
    limit = begin + K.COMM_SETUP_TIMEOUT_S
    faults = proven(rows, _candidate(seen, limit, "SLAC_FAILURE", F.lit("own-link SLAC participated but no V2G within 20s setup budget"), begin, limit), 20, 2.0)
    rest = own.join(faults.select(*SESSION), list(SESSION), "left_anti")
    return faults, rest.select(*SESSION, F.when(F.col("own"), "capture ended before 20s setup budget").otherwise("shared-PLC SLAC could not be attributed").alias("reason"))


def label(rows: DataFrame) -> DataFrame:
    """Labels with censored, censor_reason and quality_flags."""
    real = G.is_session(G.session_evidence(rows))
    rows = rows.join(real.select(*SESSION), list(SESSION), "left_semi")
    flags = G.decode_quality(rows)
    reserved = rows.where(v2g() & ~S.is_failed(F.col("resp_code")) & F.upper("ev_err").isin("RESERVED_A", "RESERVED_B", "RESERVED_C")).select(*SESSION, F.concat(F.lit("RESERVED_EV_ERROR:"), "ev_err").alias("flag"))
    reopened = G.quiet(real).where("reopened IS NOT NULL").select(*SESSION, "reopened.t", F.lit("SESSION_ABORT").alias("family"), "reopened.detail")
    pairing, unknown = unpaired(rows, real)
    parts = [marker_faults(rows, real), timer_faults(rows, real), cable_faults(rows, real), precharge_faults(rows, real, flags), pairing, G.rematch_aborts(real), G.reset_aborts(real), reopened, G.no_power(real)]
    out = G.assembled(real, G.first_faults(_join(parts)), "reviewed").join(unknown, list(SESSION), "left")
    clean = F.size("faults") == 0
    ended = F.when(F.col("charge_complete") | F.col("stop_asked"), "normal stop evidence present but SessionStopRes was not observable").otherwise("non-graceful end without positive fault evidence")
    reason = F.when(clean & F.col("reason").isNotNull(), F.col("reason")).when(clean & ~F.col("graceful_close"), ended).otherwise("")
    all_flags = flags.unionByName(reserved).groupBy(*SESSION).agg(F.array_sort(F.collect_set("flag")).alias("quality_flags"))
    out = out.withColumn("censor_reason", reason).withColumn("censored", F.col("censor_reason") != "").drop("reason")
    return out.join(all_flags, list(SESSION), "left").withColumn("quality_flags", F.coalesce("quality_flags", F.expr("cast(array() as array<string>)")))
