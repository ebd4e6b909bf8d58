"""Online features of a session's events: what an observer knows at each row, without looking ahead.

All windows are keyed by (station, connector, session ...) and so keep the sessionizer's distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from .sessions import SESSION, UP_TO, count_so_far, last_before, last_so_far, per

def v2g():
    """Rows of the dialog itself."""
    return F.col("kind") == "v2g"


def min_so_far(value, *keys: str):
    return F.min(value).over(per(*keys).rowsBetween(*UP_TO))


def max_so_far(value, *keys: str):
    return F.max(value).over(per(*keys).rowsBetween(*UP_TO))


def first_since(start, reset, *keys: str, name: str):
    """Two column expressions by name: the count of resets so far, and a function that gives the first ``start`` time since."""
    return count_so_far(reset, *keys).alias(name), lambda: min_so_far(F.when(start, F.col("t")), *keys, name)


def phases(rows: DataFrame) -> DataFrame:
    """phase, phase_elapsed, session_elapsed."""
    named = F.when(v2g(), S.phase_of(F.col("msg"))).when((F.col("kind") == "hpav") & F.col("msg").contains("SLAC_PARM.REQ"), "slac")
    rows = rows.withColumn("phase", F.coalesce(last_so_far(named, *SESSION), F.lit("idle")))
    before = F.lag("phase").over(per(*SESSION))
    rows = rows.withColumn("_turn", count_so_far((F.col("phase") != before) & before.isNotNull() | (before.isNull() & (F.col("phase") != "idle")), *SESSION))
    # the first time of the present turn: of the greatest turn so far, the least time
    begun = F.max(F.struct("_turn", (-F.col("t")).alias("m"))).over(per(*SESSION).rowsBetween(*UP_TO))
    rows = rows.withColumns({"_begun": begun, "session_elapsed": F.col("t") - min_so_far(F.col("t"), *SESSION)})
    return rows.withColumn("phase_elapsed", F.col("t") + F.col("_begun.m")).drop("_turn", "_begun")


def dialog_gap(rows: DataFrame) -> DataFrame:
    """dt_v2g: seconds since the dialog row before, on dialog rows."""
    return rows.withColumn("dt_v2g", F.when(v2g(), F.col("t") - last_before(F.when(v2g(), F.col("t")), *SESSION)))


def latency(rows: DataFrame) -> DataFrame:
    """req_res_latency: response minus the latest request of its kind; a response consumes the request."""
    base, suffix = S.msg_base(F.col("msg")), S.msg_suffix(F.col("msg"))
    rows = rows.withColumn("_base", F.when(v2g() & (suffix != ""), base).otherwise(""))
    open_at = F.last(F.when(v2g() & (suffix == "Req"), F.struct(F.lit(1).alias("open"), "t")).when(v2g() & (suffix == "Res"), F.struct(F.lit(0).alias("open"), "t")), True)
    before = open_at.over(per(*SESSION, "_base").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_open", before)
    return rows.withColumn("req_res_latency", F.when(v2g() & (suffix == "Res") & (F.col("_open.open") == 1), F.col("t") - F.col("_open.t"))).drop("_open", "_base")


def link_health(rows: DataFrame) -> DataFrame:
    """retx_60s, rst_seen, link_gap, slac_attempts."""
    tcp, hpav = F.col("kind") == "tcp", F.col("kind") == "hpav"
    trailing = Window.partitionBy(*SESSION).orderBy("t").rangeBetween(-60, 0)
    seen_now = F.sum(F.when(tcp & (F.col("msg") != "RST"), 1).otherwise(0))
    ahead = seen_now.over(trailing) - (seen_now.over(Window.partitionBy(*SESSION, "t")) - seen_now.over(Window.partitionBy(*SESSION, "t").orderBy("seq").rowsBetween(*UP_TO)))
    return (
        rows.withColumn("retx_60s", ahead)
        .withColumn("rst_seen", max_so_far(F.when(tcp & (F.col("msg") == "RST"), 1).otherwise(0), *SESSION) == 1)
        .withColumn("link_gap", F.col("t") - last_so_far(F.when(hpav & F.col("msg").contains("LINK_STATUS") & F.col("msg").endswith("CNF"), F.col("t")), *SESSION))
        .withColumn("slac_attempts", count_so_far(hpav & F.col("msg").contains("SLAC_PARM.REQ"), *SESSION))
    )


def charge_checks(rows: DataFrame) -> DataFrame:
    """cablecheck_n, cablecheck_elapsed, precharge_elapsed; needs ``phase``."""
    cable, pre = v2g() & (F.col("msg") == "CableCheckReq"), v2g() & (F.col("msg") == "PreChargeReq")
    since = lambda start: F.col("t") - min_so_far(F.when(start, F.col("t")), *SESSION)
    return (
        rows.withColumn("cablecheck_n", count_so_far(cable, *SESSION))
        .withColumn("cablecheck_elapsed", F.when(F.col("phase") == "cablecheck", F.coalesce(since(cable), F.lit(0.0))).otherwise(0.0))
        .withColumn("precharge_elapsed", F.when(F.col("phase") == "precharge", F.coalesce(since(pre), F.lit(0.0))).otherwise(0.0))
    )


def electrical(rows: DataFrame) -> DataFrame:
    """v_dev, i_dev, precharge_v_gap, v_over, i_collapse; needs ``phase``. Targets and limits are carried forward."""
    carried = lambda c: F.coalesce(F.col(c), last_so_far(F.when(v2g(), F.col(c)), *SESSION))
    rows = rows.withColumn("_tv", carried("ev_target_v")).withColumn("_ti", carried("ev_target_i")).withColumn("_mv", carried("ev_max_v"))
    reached = (F.col("evse_i") >= 0.8 * F.col("_ti")) & (F.col("_ti") > 20)
    rows = rows.withColumn("_reached", max_so_far(F.when(reached, 1).otherwise(0), *SESSION) == 1)
    collapse = (F.col("phase") == "delivery") & (F.col("_ti") > 50) & (F.col("evse_i") < F.greatest(0.15 * F.col("_ti"), F.lit(5.0))) & F.col("_reached") & ~F.coalesce(F.col("limit_achieved"), F.lit("")).contains("c")
    return (
        rows.withColumn("v_dev", F.when(F.col("_tv") != 0, F.col("evse_v") - F.col("_tv")))
        .withColumn("i_dev", F.when(F.col("_ti") != 0, F.col("evse_i") - F.col("_ti")))
        .withColumn("precharge_v_gap", F.when((F.col("phase") == "precharge") & (F.col("_tv") != 0), F.col("_tv") - F.col("evse_v")))
        .withColumn("v_over", F.coalesce((F.col("_mv") != 0) & (F.col("evse_v") > F.col("_mv") * 1.02), F.lit(False)))
        .withColumn("i_collapse", F.coalesce(collapse, F.lit(False)))
        .drop("_tv", "_ti", "_mv", "_reached")
    )


def battery(rows: DataFrame) -> DataFrame:
    """soc_rate and remaining_trend over the last 50 readings."""

    def slope(rows: DataFrame, reading: str, name: str, unit_s: float, least: float, plus: float) -> DataFrame:
        has = F.col(reading).isNotNull()
        frame = per(*SESSION, "_has").rowsBetween(-49, 0)
        rows = rows.withColumn("_has", has)
        dt = (F.col("t") - F.first("t").over(frame)) / unit_s
        change = F.col(reading) - F.first(reading).over(frame)
        return rows.withColumn("_dt", dt).withColumn("_ch", change).withColumn(name, F.when(F.col("_has") & (F.col("_dt") > least), F.col("_ch") / F.col("_dt") + plus)).drop("_has", "_dt", "_ch")

    return slope(slope(rows, "soc", "soc_rate", 1.0, 0.0, 0.0), "remaining_full_min", "remaining_trend", 60.0, 0.05, 1.0)


def collapse_runs(rows: DataFrame) -> DataFrame:
    """collapse_run: consecutive rows with a current reading that are collapsed; needs ``i_collapse``."""
    reading = F.col("evse_i").isNotNull()
    rows = rows.withColumn("_island", count_so_far(reading & ~F.col("i_collapse"), *SESSION))
    return rows.withColumn("collapse_run", F.when(reading, count_so_far(reading & F.col("i_collapse"), *SESSION, "_island"))).drop("_island")


ALPHA, BLOCK = 0.05, 500


def _recurrence(df: DataFrame, name: str, u, b: float, *keys: str) -> DataFrame:
    """``df`` with ``name``: y = b * y' + u over the readings of ``keys`` in order; needs the place ``_n``.

    y at place k is b^k times a running sum of u * b^-k. Places count from the start of a block of BLOCK readings,
    which keeps the powers in range; a block takes over the state at the end of the one before, and what that took
    over itself, decayed by b^BLOCK. What lies two blocks back weighs b^(2 BLOCK), beyond a double's precision.
    """
    k = (F.col("_n") % BLOCK).cast("double")
    end = F.col("_n") % BLOCK == BLOCK - 1
    before = lambda x: F.coalesce(last_before(F.when(end, x), *keys), F.lit(0.0))
    within = F.sum(F.col("_u") * F.pow(F.lit(b), -k)).over(per(*keys, "_block").rowsBetween(*UP_TO)) * F.pow(F.lit(b), k)
    df = df.withColumn("_u", u).withColumn("_block", F.floor(F.col("_n") / BLOCK)).withColumn("_w", within)
    df = df.withColumn("_h", before(F.col("_w")))
    df = df.withColumn("_h", before(F.col("_w") + F.pow(F.lit(b), F.lit(float(BLOCK))) * F.col("_h")))
    return df.withColumn(name, F.col("_w") + F.col("_h") * F.pow(F.lit(b), k + 1.0)).drop("_u", "_w", "_h", "_block")


def ewm_readings(read: DataFrame, value: str, prefix: str, *keys: str, alpha: float = ALPHA) -> DataFrame:
    """``read``, whose ``value`` is never null, with {prefix}_mean, {prefix}_var and {prefix}_z; windows only, no join."""
    b, x = 1 - alpha, F.col(value)
    read = read.withColumn("_n", F.row_number().over(per(*keys)) - 1)
    first = F.col("_n") == 0
    read = _recurrence(read, f"{prefix}_mean", F.when(first, x).otherwise(alpha * x), b, *keys)
    read = read.withColumn("_m0", F.lag(f"{prefix}_mean").over(per(*keys)))
    read = _recurrence(read, f"{prefix}_var", F.when(first, 0.0).otherwise(b * alpha * F.pow(x - F.col("_m0"), 2)), b, *keys)
    sigma = F.sqrt(F.lag(f"{prefix}_var").over(per(*keys)))
    z = F.coalesce((x - F.col("_m0")) / F.greatest(sigma, 0.005 * F.abs("_m0") + 1e-6), F.lit(0.0))
    return read.withColumn(f"{prefix}_z", z).drop("_n", "_m0")


def ewm(rows: DataFrame, value: str, prefix: str, *keys: str, alpha: float = ALPHA) -> DataFrame:
    """{prefix}_mean, {prefix}_var and {prefix}_z of the non-null readings of ``value``; z is taken before a
    reading is absorbed, against a floor of 0.5 % of the mean."""
    keys = keys or SESSION
    read = rows.where(F.col(value).isNotNull()).select(*keys, "t", "seq", F.col(value).alias("_x"))
    read = ewm_readings(read, "_x", prefix, *keys, alpha=alpha)
    return rows.join(read.select(*keys, "seq", *[f"{prefix}_{c}" for c in ("mean", "var", "z")]), [*keys, "seq"], "left")


def smoothed(rows: DataFrame) -> DataFrame:
    """latency_z, gap_z, v_ripple_z, i_ripple_z, 0 where there is no reading; needs the tracked features.

    Latency is smoothed throughout, the dialog gap where delivery was on before the row, voltage and current during
    delivery. The four series are stacked, so one pass smooths all of them.
    """
    delivery = F.col("phase") == "delivery"
    was = F.coalesce(F.lag("phase").over(per(*SESSION)), F.lit("idle"))
    rows = rows.withColumn("_was", was)
    series = {
        "latency": F.col("req_res_latency"), "gap": F.when(F.col("_was") == "delivery", F.col("dt_v2g")),
        "v_ripple": F.when(delivery, F.col("evse_v")), "i_ripple": F.when(delivery, F.col("evse_i")),
    }
    stacked = F.explode(F.array_compact(F.array(*[F.when(x.isNotNull(), F.struct(F.lit(n).alias("n"), x.cast("double").alias("x"))) for n, x in series.items()])))
    read = rows.select(*SESSION, "t", "seq", stacked.alias("r")).select(*SESSION, "t", "seq", F.col("r.n").alias("_series"), F.col("r.x").alias("_x"))
    z = ewm_readings(read, "_x", "_s", *SESSION, "_series")
    wide = z.groupBy(*SESSION, "seq").agg(*[F.max(F.when(F.col("_series") == n, F.col("_s_z"))).alias(f"{n}_z") for n in series])
    return rows.drop("_was").join(wide, [*SESSION, "seq"], "left").fillna(0.0, [f"{n}_z" for n in series])


def tracked(rows: DataFrame) -> DataFrame:
    """All features without smoothing."""
    for step in (phases, dialog_gap, latency, link_health, charge_checks, electrical, battery, collapse_runs):
        rows = step(rows)
    return rows


def phase_durations(rows: DataFrame) -> DataFrame:
    """(session, phase): seconds between its first and last row, rows, mean latency; needs tracked features."""
    return rows.groupBy(*SESSION, "phase").agg((F.max("t") - F.min("t")).alias("seconds"), F.count("*").alias("n_rows"), F.avg("req_res_latency").alias("mean_latency"))


def session_observations(rows: DataFrame) -> DataFrame:
    """One row per session: {phase}_s (from the last entry into a phase to the next phase), mean_latency, mean_ripple,
    reached_delivery, graceful; needs tracked and smoothed features."""
    before = F.coalesce(F.lag("phase").over(per(*SESSION)), F.lit("idle"))
    turn = rows.withColumn("_before", before).withColumn("_turn", F.col("phase") != F.col("_before"))
    turn = turn.withColumn("_entered", last_before(F.when(F.col("_turn"), F.col("t")), *SESSION))
    spans = [F.max_by(F.when(F.col("_turn") & (F.col("_before") == p), F.col("t") - F.col("_entered")), F.when(F.col("_turn") & (F.col("_before") == p), F.struct("t", "seq"))).alias(f"{p}_s") for p in K.PHASES[1:]]
    ripple = F.when((F.col("phase") == "delivery") & (F.abs("v_ripple_z") > 0), F.abs("v_ripple_z"))
    return turn.groupBy(*SESSION).agg(*spans, F.avg("req_res_latency").alias("mean_latency"), F.avg(ripple).alias("mean_ripple"), F.bool_or(F.col("phase") == "delivery").alias("reached_delivery"), F.bool_or(v2g() & (F.col("msg") == "SessionStopRes")).alias("graceful"))


def feature_vector(rows: DataFrame) -> DataFrame:
    """The 33 scaled and clipped numbers that models read, in a fixed order, as ``vector``; needs tracked and smoothed features (a missing column counts as 0)."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    nz = lambda c, d=0.0: F.coalesce(have(c).cast("double"), F.lit(d))
    upto = lambda x, top: F.least(x, F.lit(top))
    within = lambda x, top: F.greatest(F.least(x, F.lit(top)), F.lit(-top))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = F.col("notification")
    parts = [
        K.lookup({p: i / 6.0 for i, p in enumerate(K.PHASES)}, F.col("phase"), 0.0),
        upto(nz("phase_elapsed") / 60, 5.0), upto(nz("session_elapsed") / 600, 5.0), upto(nz("dt_v2g"), 10.0), upto(nz("req_res_latency") / 0.25, 10.0),
        within(nz("latency_z"), 8.0), within(nz("v_dev") / 50, 8.0), within(nz("i_dev") / 50, 8.0), within(nz("v_ripple_z"), 8.0), within(nz("i_ripple_z"), 8.0),
        nz("soc", 50.0) / 100, within(nz("soc_rate") * 60, 5.0), upto(nz("remaining_full_min") / 60, 5.0), within(nz("remaining_trend"), 5.0),
        upto(nz("retx_60s") / 20, 3.0), flag(F.col("rst_seen")), upto(nz("link_gap") / 5, 10.0), upto(nz("slac_attempts") / 3, 3.0),
        upto(nz("cablecheck_n") / 40, 3.0), upto(nz("cablecheck_elapsed") / 40, 3.0), upto(nz("precharge_elapsed") / 7, 3.0), within(nz("precharge_v_gap") / 50, 8.0),
        F.when(n.isin("Warning", "ReNegotiation"), 1.0).when(n.isin("Stop", "StopCharging"), 2.0).otherwise(0.0),
        flag(F.col("isolation") == "Warning"), F.length("limit_achieved").cast("double"), flag(S.validation_bad(F.col("validation"))),
        flag(F.col("i_collapse")), flag(F.col("v_over")), within(nz("gap_z"), 8.0), flag(S.is_failed(F.col("resp_code"))),
        flag(F.col("evse_status").isin("EVSE_Malfunction", "EVSE_EmergencyShutdown")), flag(~F.col("ev_err").isin("", "NO_ERROR")), flag(F.col("isolation") == "Fault"),
    ]
    return rows.withColumn("vector", F.array(*parts))


# ---------------------------------------------------------------- conformance


def dialogs(rows: DataFrame) -> DataFrame:
    """dialog: the number of dialogs opened so far in the session (0 before the first)."""
    marker = F.when(v2g() & (F.col("msg").endswith("Res") | (F.col("msg") == "supportedAppProtocolReq")), F.col("msg"))
    # an opened dialog forgets the last response, so the first opener's own name stands for "none"
    after_handshake = F.coalesce(last_before(marker, *SESSION) == "supportedAppProtocolRes", F.lit(False))
    opens = v2g() & ((F.col("msg") == "supportedAppProtocolReq") | ((F.col("msg") == "SessionSetupReq") & ~after_handshake))
    return rows.withColumn("dialog", count_so_far(opens, *SESSION))


DIALOG = (*SESSION, "dialog")


def message_timers(rows: DataFrame) -> DataFrame:
    """msg_timeout_ratio: the worst of this response's and all outstanding requests' times over their limits;
    msg_timeout_max (so far), msg_perf_ratio, n_msg_breach (each request counts once), last_timeout_msg (the request
    that is past its limit at this row, "" if none); needs ``dialog``."""
    suffix = S.msg_suffix(F.col("msg"))
    rows = rows.withColumn("_base", F.when(v2g() & (suffix != ""), S.msg_base(F.col("msg"))).otherwise(""))
    state = F.when(v2g() & (suffix == "Req"), F.col("t")).when(v2g() & (suffix == "Res"), F.lit(-1.0))
    sent = {req: last_so_far(F.when(F.col("_base") == req[:-3], state), *DIALOG) for req in K.MSG_TIMEOUT_S}
    rows = rows.withColumns({"_sent": F.array(*sent.values()), "_pt": F.lag("t").over(per(*DIALOG))})
    asked = F.last(state, True).over(per(*DIALOG, "_base").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_asked", F.when(v2g() & (suffix == "Res"), asked))
    rows = rows.withColumn("_lat", F.when(F.col("_asked") >= 0, F.col("t") - F.col("_asked"))).withColumn("_limit", K.lookup({k[:-3]: v for k, v in K.MSG_TIMEOUT_S.items()}, F.col("_base")))
    # a request is counted at the first row past its limit: the row before, still within the wait, was not
    late, breaches = [], F.when((F.col("_lat") >= F.col("_limit")) & (F.col("_pt") - F.col("_asked") < F.col("_limit")), 1).otherwise(0)
    for i, (req, limit) in enumerate(K.MSG_TIMEOUT_S.items()):
        at = F.col("_sent")[i]
        late.append(F.when(at >= 0, F.struct(((F.col("t") - at) / limit).alias("ratio"), F.lit(req).alias("req"))))
        breaches = breaches + F.when((at >= 0) & (F.col("t") - at >= limit) & (F.col("_pt") - at < limit), 1).otherwise(0)
    answered = F.when(F.col("_lat").isNotNull() & F.col("_limit").isNotNull(), F.struct((F.col("_lat") / F.col("_limit")).alias("ratio"), F.concat("_base", F.lit("Req")).alias("req")))
    rows = rows.withColumns({"_worst": F.greatest(*late, answered), "_b": breaches})
    ratio = F.coalesce(F.col("_worst.ratio"), F.lit(0.0))
    rows = rows.withColumns({
        "msg_timeout_ratio": ratio, "last_timeout_msg": F.when(ratio >= 1, F.col("_worst.req")).otherwise(""),
        "msg_perf_ratio": F.coalesce(F.col("_lat") / K.lookup(K.RES_PERFORMANCE_S, F.col("msg")), F.lit(0.0)),
    })
    over = per(*SESSION).rowsBetween(*UP_TO)
    return rows.withColumns({"msg_timeout_max": F.max("msg_timeout_ratio").over(over), "n_msg_breach": F.sum("_b").over(over)}).drop("_base", "_lat", "_sent", "_pt", "_asked", "_limit", "_worst", "_b")


def sequence_timer(rows: DataFrame) -> DataFrame:
    """seq_gap_s since the last response that still owes a request (0 if none), seq_gap_ratio (of 40 s),
    seq_timeout_ratio (of 60 s), n_seq_breach (requests that came after 40 s or more); needs ``dialog``."""
    req, res = F.col("msg").endswith("Req"), F.col("msg").endswith("Res")
    ends = (F.col("msg") == "SessionStopRes") | S.is_failed(F.col("resp_code"))
    state = F.when(v2g() & req, F.lit(-1.0)).when(v2g() & res & ends, F.lit(-1.0)).when(v2g() & res, F.col("t"))
    rows = rows.withColumns({"_owed": last_so_far(state, *DIALOG), "_due": last_before(state, *DIALOG)})
    gap = F.when(F.col("_owed") >= 0, F.col("t") - F.col("_owed")).otherwise(0.0)
    late = v2g() & req & (F.col("_due") >= 0) & (F.col("t") - F.col("_due") >= K.SEQ_PERFORMANCE_S)
    rows = rows.withColumns({"seq_gap_s": gap, "n_seq_breach": count_so_far(late, *SESSION)}).drop("_owed", "_due")
    return rows.withColumns({"seq_gap_ratio": F.col("seq_gap_s") / K.SEQ_PERFORMANCE_S, "seq_timeout_ratio": F.col("seq_gap_s") / K.SEQ_TIMEOUT_S})


def ongoing_timer(rows: DataFrame) -> DataFrame:
    """ongoing_s since processing was first Ongoing (0 if not), ongoing_ratio (of 60 s), ongoing_breach (from 55 s); needs ``dialog``."""
    res = v2g() & F.col("msg").endswith("Res")
    reset = (v2g() & (F.col("evse_processing") == "Finished")) | (res & ((F.col("msg") == "SessionStopRes") | S.is_failed(F.col("resp_code"))) & (F.col("evse_processing") != "Ongoing"))
    # a response that ends the dialog and is itself Ongoing resets first and starts anew
    restart = res & ((F.col("msg") == "SessionStopRes") | S.is_failed(F.col("resp_code"))) & (F.col("evse_processing") == "Ongoing")
    rows = rows.withColumn("_r", count_so_far(reset | restart, *DIALOG))
    # of the greatest reset so far, the least time: valid while no reset came after it
    start = F.max(F.when(v2g() & (F.col("evse_processing") == "Ongoing"), F.struct("_r", (-F.col("t")).alias("m")))).over(per(*DIALOG).rowsBetween(*UP_TO))
    rows = rows.withColumn("_o", start)
    rows = rows.withColumn("ongoing_s", F.when(F.col("_o._r") == F.col("_r"), F.col("t") + F.col("_o.m")).otherwise(0.0)).drop("_r", "_o")
    return rows.withColumns({"ongoing_ratio": F.col("ongoing_s") / K.ONGOING_TIMEOUT_S, "ongoing_breach": F.col("ongoing_s") >= K.ONGOING_PERFORMANCE_S})


def setup_timer(rows: DataFrame) -> DataFrame:
    """comm_setup_s from the link's readiness to SessionSetupRes, growing until then; 0 before a dialog opens. Needs ``dialog``."""
    link = F.when((F.col("kind") == "hpav") & F.col("msg").contains("SLAC_MATCH.CNF"), F.col("t"))
    ready = F.greatest(last_so_far(link, *SESSION), min_so_far(F.col("t"), *DIALOG))  # a dialog's first row is its opener
    done = min_so_far(F.when(v2g() & (F.col("msg") == "SessionSetupRes"), F.col("t")), *DIALOG)
    return rows.withColumn("comm_setup_s", F.when(F.col("dialog") == 0, 0.0).otherwise(F.coalesce(done, F.col("t")) - ready))


def cable_and_precharge(rows: DataFrame) -> DataFrame:
    """cablecheck_s (stops at its end), cablecheck_open, precharge_s (0 once power is asked for), their ratios of 40 and
    7 s, cablecheck_breach, precharge_breach, and precharge_v_gap_ratio: the gap to the target in bands of 20 V or 5 %,
    from half the timer on; needs ``dialog``."""
    cable = min_so_far(F.when(v2g() & (F.col("msg") == "CableCheckReq"), F.col("t")), *DIALOG)
    rows = rows.withColumn("_c0", cable)
    ok = v2g() & (F.col("msg") == "CableCheckRes") & (S.rc_severity(F.col("resp_code")) == 0) & (F.col("evse_processing") == "Finished")
    ended = ok | (v2g() & (F.col("msg") == "PreChargeReq") & F.col("_c0").isNotNull())
    rows = rows.withColumn("_c1", min_so_far(F.when(ended, F.col("t")), *DIALOG))
    pre = min_so_far(F.when(v2g() & (F.col("msg") == "PreChargeReq"), F.col("t")), *DIALOG)
    power = max_so_far(F.when(v2g() & (F.col("msg") == "PowerDeliveryReq"), 1).otherwise(0), *DIALOG)
    target = last_so_far(F.when(v2g(), F.col("ev_target_v")), *SESSION)
    rows = rows.withColumns({
        "cablecheck_s": F.coalesce(F.coalesce(F.col("_c1"), F.col("t")) - F.col("_c0"), F.lit(0.0)),
        "cablecheck_open": F.col("_c0").isNotNull() & F.col("_c1").isNull(),
        "precharge_s": F.when(power == 1, 0.0).otherwise(F.coalesce(F.col("t") - pre, F.lit(0.0))),
        "_target": target,
    })
    rows = rows.withColumns({"cablecheck_ratio": F.col("cablecheck_s") / K.CABLECHECK_TIMEOUT_S, "precharge_ratio": F.col("precharge_s") / K.PRECHARGE_TIMEOUT_S})
    far = (F.col("precharge_ratio") >= 0.5) & F.col("evse_v").isNotNull() & (F.col("_target") != 0)
    return rows.withColumns({
        "cablecheck_breach": F.col("cablecheck_open") & (F.col("cablecheck_ratio") >= 1), "precharge_breach": F.col("precharge_ratio") >= 1,
        "precharge_v_gap_ratio": F.when(far, F.abs(F.col("_target") - F.col("evse_v")) / F.greatest(F.lit(20.0), 0.05 * F.col("_target"))).otherwise(0.0),
    }).drop("_c0", "_c1", "_target")


def sequence_legality(rows: DataFrame) -> DataFrame:
    """seq_illegal, n_seq_illegal, stage_max, stage_regress; needs ``dialog``."""
    last_res = last_before(F.when(v2g() & F.col("msg").endswith("Res"), F.col("msg")), *DIALOG)
    # the opener itself is the first row of its dialog, so nothing stands before it
    legal = F.element_at(F.create_map(*[x for k, v in K.NEXT_REQ.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))]), F.coalesce(last_res, F.lit("")))
    illegal = v2g() & F.col("msg").endswith("Req") & (F.col("dialog") > 0) & ~F.array_contains(legal, F.col("msg"))
    rows = rows.withColumn("seq_illegal", F.coalesce(illegal, F.lit(False)))
    stage = F.when(v2g(), S.stage_index(F.col("msg")))
    rows = rows.withColumn("n_seq_illegal", count_so_far(F.col("seq_illegal"), *SESSION)).withColumn("stage_max", F.coalesce(max_so_far(stage, *SESSION), F.lit(-1)))
    return rows.withColumn("stage_regress", F.coalesce((stage < F.col("stage_max")) & F.col("seq_illegal"), F.lit(False)))


def severities(rows: DataFrame) -> DataFrame:
    """rc_sev, evse_sev, isolation_sev, notification_sev, ev_err_sev, and voltage and current over the announced maxima."""
    over = lambda v, m: F.coalesce(F.col(v) / F.nullif(last_so_far(F.when(v2g(), F.col(m)), *SESSION), F.lit(0.0)) - 1, F.lit(0.0))
    return (
        rows.withColumn("rc_sev", S.rc_severity(F.col("resp_code")))
        .withColumn("evse_sev", S.evse_severity(F.col("evse_status")))
        .withColumn("isolation_sev", S.isolation_severity(F.col("isolation")))
        .withColumn("notification_sev", S.notification_severity(F.col("notification")))
        .withColumn("ev_err_sev", S.ev_error_severity(F.col("ev_err")))
        .withColumn("v_over_max", over("evse_v", "evse_max_v"))
        .withColumn("i_over_max", over("evse_i", "evse_max_i"))
    )


def conformance(rows: DataFrame) -> DataFrame:
    """All conformance features."""
    for step in (dialogs, message_timers, sequence_timer, ongoing_timer, setup_timer, cable_and_precharge, sequence_legality, severities):
        rows = step(rows)
    return rows


def conformance_vector(rows: DataFrame) -> DataFrame:
    """The 27 clipped numbers of the conformance features, in a fixed order, as ``conformance_vector``."""
    top = lambda c, by=1.0, most=8.0: F.greatest(F.least(F.col(c) / by, F.lit(most)), F.lit(0.0))
    over = lambda c: F.greatest(F.least(F.col(c), F.lit(4.0)), F.lit(-1.0))
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    parts = [
        top("msg_timeout_ratio"), top("msg_timeout_max"), top("msg_perf_ratio"), top("n_msg_breach", 5.0), top("seq_gap_ratio"), top("seq_timeout_ratio"), top("n_seq_breach", 3.0),
        top("ongoing_ratio"), flag("ongoing_breach"), F.greatest(F.least(F.col("comm_setup_s") / K.COMM_SETUP_TIMEOUT_S, F.lit(8.0)), F.lit(0.0)),
        top("cablecheck_ratio"), flag("cablecheck_breach"), top("precharge_ratio"), flag("precharge_breach"), flag("seq_illegal"), top("n_seq_illegal", 3.0),
        F.greatest(F.col("stage_max"), F.lit(0)) / float(len(K.DC_STAGES) - 1), flag("stage_regress"), F.col("rc_sev"), F.col("evse_sev"), F.col("isolation_sev"), F.col("notification_sev"), F.col("ev_err_sev"),
        over("v_over_max"), over("i_over_max"), top("precharge_v_gap_ratio"), F.least(F.greatest(F.col("dialog") - 1, F.lit(0)).cast("double"), F.lit(4.0)),
    ]
    return rows.withColumn("conformance_vector", F.array(*[p.cast("double") for p in parts]))


def narrow(rows: DataFrame, n: int, column: str = "vector") -> DataFrame:
    """``rows`` whose vectors keep their first ``n`` numbers; a shorter vector is an error."""
    short = F.assert_true(F.size(column) >= n, F.lit(f"a vector has fewer than {n} numbers"))
    return rows.withColumn(column, F.when(short.isNull(), F.slice(column, 1, n)))


# ---------------------------------------------------------------- matching


def matching(rows: DataFrame) -> DataFrame:
    """slac_stage, matched, v2g_seen, match_pending_s, awaiting_s, n_match_req, n_restart, since_match_s."""
    hpav = F.col("kind") == "hpav"
    has = lambda name: hpav & F.col("msg").contains(name)
    stage = F.when(F.lit(False), 0)
    for i, name in enumerate(K.SLAC_STAGES):
        stage = stage.when(has(name), i + 1)
    rows = rows.withColumn("_stage", stage)
    late = F.when(F.col("_stage") == 1, 1).when(F.col("_stage") > 2, 2)
    req, cnf = F.col("_stage") == K.SLAC_STAGES.index("SLAC_MATCH.REQ") + 1, F.col("_stage") == K.SLAC_STAGES.index("SLAC_MATCH.CNF") + 1
    rows = rows.withColumn("_cnf", count_so_far(cnf, *SESSION)).withColumn("_asked", count_so_far(has("VALIDATE.REQ") | req, *SESSION))
    # a row that both starts and ends a wait cannot occur: the names exclude each other
    pending = min_so_far(F.when(req, F.col("t")), *SESSION, "_cnf")
    awaiting = min_so_far(F.when(has("ATTEN_CHAR.RSP"), F.col("t")), *SESSION, "_asked")
    restart = (F.col("_stage") == 1) & (last_before(late, *SESSION) == 2)
    zero = lambda x: F.coalesce(F.col("t") - x, F.lit(0.0))
    return (
        rows.withColumn("slac_stage", F.coalesce(max_so_far(F.col("_stage"), *SESSION), F.lit(0)))
        .withColumn("matched", F.col("_cnf") > 0)
        .withColumn("v2g_seen", max_so_far(F.when(v2g(), 1).otherwise(0), *SESSION) == 1)
        .withColumn("match_pending", pending.isNotNull())
        .withColumn("match_pending_s", zero(pending))
        .withColumn("awaiting", awaiting.isNotNull())
        .withColumn("awaiting_s", zero(awaiting))
        .withColumn("n_match_req", count_so_far(req, *SESSION))
        .withColumn("n_restart", count_so_far(restart, *SESSION))
        .withColumn("since_match_s", zero(last_so_far(F.when(cnf, F.col("t")), *SESSION)))
        .drop("_stage", "_cnf", "_asked")
    )
