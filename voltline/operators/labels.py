"""Fault labels of sessions: when each fault family first shows, how the session ended, and what stays unknown.

``rows`` are sessionized events. Profile "strict" labels what the dialog itself proves; "reviewed" applies
the standard's own timers, each only where the capture provably went on, and censors what it cannot know.

All strict rules read one pass over the rows: running state and the session's own bounds stand on every row
(``marked``), and one aggregate by session (``session_evidence``) keeps the first candidate of each rule. Whatever
follows works on one row per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from .features import v2g
from .sessions import SESSION, UP_TO, count_so_far, last_before, per


def cd():
    """Rows of power delivery."""
    return v2g() & F.col("msg").startswith("CurrentDemand")


FREEZE_S, CABLE_STRICT_S, SLAC_SLOW_S, PRECHARGE_S = 5.0, 60.0, 60.0, 10.0
ALIVE_ROWS, ALIVE_S = 20, 10.0
FAULT = "struct<t: double, family: string, detail: string>"
LIMITS = {k[:-3]: s for k, s in K.MSG_TIMEOUT_S.items()}


def whole() -> Window:
    """All rows of a session."""
    return Window.partitionBy(*SESSION)


def _faults(rows: DataFrame, t: Column, family: str, detail: Column) -> DataFrame:
    return rows.select(*SESSION, t.cast("double").alias("t"), F.lit(family).alias("family"), detail.alias("detail"))


def _at(condition: Column) -> Column:
    return F.when(condition, F.col("t"))


def _says(condition: Column, t: Column, detail: Column) -> Column:
    return F.when(condition, F.struct(t.cast("double").alias("t"), detail.alias("detail")))


def _is_msg(*names: str) -> Column:
    return v2g() & F.col("msg").isin(*names)


def _slac() -> Column:
    return (F.col("kind") == "hpav") & (F.col("msg").contains("SLAC") | F.col("msg").contains("ATTEN_CHAR"))


def _stated() -> dict[str, tuple[Column, Column]]:
    """Condition and detail by family of dialog rows that state a fault themselves."""
    return {
        "PROTOCOL_FAILED": (v2g() & S.is_failed(F.col("resp_code")), F.concat_ws(":", "msg", "resp_code")),
        "EVSE_FAULT": (v2g() & F.col("evse_status").isin("EVSE_Malfunction", "EVSE_EmergencyShutdown"), F.concat_ws(":", "msg", "evse_status")),
        "ISOLATION_FAULT": (v2g() & (F.col("isolation") == "Fault"), F.concat(F.col("msg"), F.lit(":IsolationFault"))),
        "EV_ERROR": (v2g() & ~F.col("ev_err").isin("", "NO_ERROR"), F.concat_ws(":", "msg", "ev_err")),
    }


def marker_faults(rows: DataFrame) -> DataFrame:
    """(session, t, family, detail) of rows that state a fault themselves: failed responses, EVSE status, isolation, EV errors."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(f).alias("family"), d.alias("detail"))) for f, (c, d) in _stated().items()]))
    return rows.where(v2g()).select(*SESSION, "t", F.explode(found).alias("f")).select(*SESSION, "t", "f.family", "f.detail")


def _fact_columns() -> list[Column]:
    dc = v2g() & S.msg_base(F.col("msg")).isin("ChargeParameterDiscovery", "CableCheck", "PreCharge", "PowerDelivery")
    return [
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_events"),
        F.count_if(v2g()).alias("n_v2g"), F.count_if(_slac()).alias("n_slac"), F.min(_at(_slac())).alias("first_slac"), F.min(_at(v2g())).alias("first_v2g"),
        F.min(_at(cd())).alias("first_cd"), F.max(_at(cd())).alias("last_cd"),
        F.max(_at(_is_msg("SessionStopRes") & ~S.is_failed(F.col("resp_code")))).alias("stop_res"), F.min(_at(_is_msg("SessionStopReq"))).alias("stop_req"),
        F.max(_at(_is_msg(*K.OPENERS))).alias("last_opener"), F.min(_at(_is_msg("ChargeParameterDiscoveryReq"))).alias("param_req"),
        F.min(_at(_is_msg("CableCheckReq"))).alias("cable_req"), F.max(_at(dc)).alias("last_dc"),
        F.max(_at(v2g() & F.col("msg").startswith("CableCheck"))).alias("last_cable"),
        F.bool_or(v2g() & F.col("msg").startswith("PreCharge")).alias("has_precharge"), F.bool_or(v2g() & F.col("msg").startswith("PowerDelivery")).alias("has_power"),
        F.bool_or(cd() & S.truthy(F.col("charge_complete"))).alias("charge_complete"), F.bool_or(v2g() & (F.col("notification") == "StopCharging")).alias("stop_asked"),
    ]


def _closed(facts: DataFrame) -> DataFrame:
    graceful = F.col("stop_res").isNotNull() & (F.col("last_opener").isNull() | (F.col("stop_res") >= F.col("last_opener")))
    return facts.withColumn("graceful_close", graceful).withColumn("reached_current_demand", F.col("first_cd").isNotNull())


def session_facts(rows: DataFrame) -> DataFrame:
    """One row per session: bounds, first and last delivery, stops, openers, graceful_close, reached_current_demand."""
    return _closed(rows.groupBy(*SESSION).agg(*_fact_columns()))


def is_session(facts: DataFrame) -> DataFrame:
    return facts.where("n_v2g > 0 OR n_slac >= 3")


def with_facts(rows: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    return rows.join(facts.select(*SESSION, *columns), list(SESSION))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with the running state that the rules look at, and the session's bounds on every row.

    Running: _before (the dialog row before), _since (the response that still owes a request, else -1), _opens and
    _n (dialogs), _o (since when processing is Ongoing within one response's phase). Around matching requests:
    _prv, _nxt (dialog rows strictly before and after), _answered, _again.
    """
    x, base = S.msg_suffix(F.col("msg")), S.msg_base(F.col("msg"))
    v = rows.withColumn("_x", F.when(v2g(), x).otherwise("")).withColumn("_base", F.when(F.col("_x") != "", base))
    req, res = F.col("_x") == "Req", F.col("_x") == "Res"
    before = lambda value: last_before(value, *SESSION)
    last_res = F.coalesce(before(F.when(res, F.col("msg"))), F.lit(""))
    v = v.withColumns({"_before": before(_at(v2g())), "_since": before(F.when(req, F.lit(-1.0)).when(res, F.col("t"))), "_q": before(F.col("_base"))})
    v = v.withColumn("_opens", v2g() & ((F.col("msg") == "supportedAppProtocolReq") | ((F.col("msg") == "SessionSetupReq") & (last_res != "supportedAppProtocolRes"))))
    turn = (F.col("_base") != F.col("_q")) | ((F.col("evse_processing") == "Finished") & res)
    v = v.withColumns({"_n": count_so_far(F.col("_opens"), *SESSION), "_g": count_so_far(turn, *SESSION)})
    # the first Ongoing of the present phase: of the greatest phase so far, the least time
    ongoing = res & (F.col("evse_processing") == "Ongoing")
    v = v.withColumn("_o", F.max(F.when(ongoing, F.struct("_g", (-F.col("t")).alias("m")))).over(per(*SESSION).rowsBetween(*UP_TO)))
    v = v.withColumn("_o", F.when(F.col("_o._g") == F.col("_g"), -F.col("_o.m")))
    # rows at the same instant are neither before nor after; frames run forward or backward from the session's edge, never both ways
    over = lambda what, order, edge: F.expr(f"{what} OVER (PARTITION BY {', '.join(SESSION)} ORDER BY t {order} RANGE BETWEEN UNBOUNDED PRECEDING AND {edge})")
    apart, v2g_t = "0.000001D PRECEDING", "CASE WHEN kind = 'v2g' THEN t END"
    v = v.withColumn("_prv", over(f"max({v2g_t})", "ASC", apart)).withColumns({
        "_nxt": over(f"min({v2g_t})", "DESC", apart),
        "_cnf": over("min(CASE WHEN kind = 'hpav' AND contains(msg, 'SLAC_PARM.CNF') THEN t END)", "DESC", "CURRENT ROW"),
        "_again": F.coalesce(over("bool_or(kind = 'v2g' AND msg = 'supportedAppProtocolReq')", "DESC", apart), F.lit(False)),
    })
    bounds = {
        "_t_end": F.max("t"), "_first_v2g": F.min(_at(v2g())), "_first_cd": F.min(_at(cd())), "_last_cd": F.max(_at(cd())), "_cable_req": F.min(_at(_is_msg("CableCheckReq"))),
        "_stop_res": F.max(_at(_is_msg("SessionStopRes") & ~S.is_failed(F.col("resp_code")))), "_last_opener": F.max(_at(_is_msg(*K.OPENERS))),
        "_streams": F.collect_set(F.when(v2g() & (F.col("tcp_stream") != ""), F.col("tcp_stream"))),
    }
    v = v.withColumns({name: value.over(whole()) for name, value in bounds.items()})
    return v.withColumn("_graceful", F.col("_stop_res").isNotNull() & (F.col("_last_opener").isNull() | (F.col("_stop_res") >= F.col("_last_opener"))))


def session_evidence(rows: DataFrame) -> DataFrame:
    """One row per session: the facts, and by rule the first candidate (t, detail) or null.

    stated_<family>, stuck, stall, unmatched, slow, rematch, reset, no_power, silent, broken (what shows that a dialog without graceful close broke: a
    dialog reopened, 60 s without the next request, Ongoing for 60 s, a request unanswered past its limit; where
    nothing follows, the link must have stayed alive), reopened.
    """
    v = marked(rows)
    t, req, res = F.col("t"), F.col("_x") == "Req", F.col("_x") == "Res"
    # what still waits at the session's end: by message, the last request past its limit; the last response; Ongoing
    ends = {b: F.max(F.when(F.col("_base") == b, F.struct("t", "seq", "_x"))).over(whole()) for b in LIMITS}
    ends |= {"": F.max(F.when(F.col("_x") != "", F.struct("t", "seq", "_x"))).over(whole()), "o": F.max(F.when(v2g(), F.struct("t", "seq", "_o"))).over(whole())}
    v = v.withColumns({f"_e{i}": end for i, end in enumerate(ends.values())})
    waits: list[tuple[Column, Column]] = []
    for i, (base, limit) in enumerate(LIMITS.items()):
        e = F.col(f"_e{i}")
        waits.append((F.when((e._x == "Req") & (F.col("_t_end") - e.t >= limit), e.t + limit), F.lit(f"{base}Req unanswered past its {limit}s timeout [V2G2-438]")))
    last, o = F.col(f"_e{len(LIMITS)}"), F.col(f"_e{len(LIMITS) + 1}._o")
    waits.append((F.when((last._x == "Res") & (F.col("_t_end") - last.t >= K.SEQ_TIMEOUT_S), last.t + K.SEQ_TIMEOUT_S), F.lit("no further request for 60s [V2G2-443]")))
    waits.append((F.when(F.col("_t_end") - o >= K.ONGOING_TIMEOUT_S, o + K.ONGOING_TIMEOUT_S), F.lit("EVSEProcessing left Ongoing past 60s [V2G2-711]")))
    gap, span = t - F.col("_since"), t - F.col("_o")
    reopened = _says(F.col("_opens") & (F.col("_n") > 1), t, F.format_string("dialog reopened after an error [8.8.1] (#%d)", "_n"))
    idle = _says(req & (F.col("_since") >= 0) & (gap >= K.SEQ_TIMEOUT_S), F.col("_since") + K.SEQ_TIMEOUT_S, F.format_string("no request for %.0fs [V2G2-443]", gap))
    slow = _says(res & (F.col("evse_processing") == "Ongoing") & (span >= K.ONGOING_TIMEOUT_S), F.col("_o") + K.ONGOING_TIMEOUT_S, F.format_string("EVSEProcessing Ongoing %.0fs [V2G2-711]", span))
    prv = F.coalesce("_prv", "_first_v2g")
    asks = (F.col("kind") == "hpav") & F.col("msg").contains("SLAC_PARM.REQ") & (t > F.col("_first_v2g") + 1.0) & ~(F.col("_graceful") & (t > F.col("_stop_res")))
    broke = F.col("_nxt").isNull() | (F.col("_nxt") - prv > FREEZE_S) | F.coalesce(F.col("_cnf") <= t + 10.0, F.lit(False)) | F.col("_again")
    own = (F.size("_streams") == 0) | F.array_contains("_streams", F.col("tcp_stream"))
    pause = t - F.col("_before")
    stalls = v2g() & (F.col("_before") >= F.col("_first_cd")) & (t <= F.col("_last_cd")) & (pause > FREEZE_S)
    facts = v.groupBy(*SESSION).agg(
        *_fact_columns(),
        *[F.min(_says(c, t, d)).alias(f"stated_{f}") for f, (c, d) in _stated().items()],
        F.min(_at(_is_msg("PreChargeReq", "PowerDeliveryReq") & (t > F.col("_cable_req")))).alias("cable_end"),
        F.min(_says(stalls, F.col("_before") + FREEZE_S, F.format_string("stall %.1fs in power delivery", pause))).alias("stall"),
        F.min(F.when(asks & broke, F.struct("t", "seq", prv.alias("prv")))).alias("_rematch"),
        F.min(_at((F.col("kind") == "tcp") & (F.col("msg") == "RST") & (t >= F.col("_first_v2g")) & own)).alias("_reset"),
        F.min(reopened).alias("reopened"), F.min(idle).alias("_idle"), F.min(slow).alias("_slow"),
        *[F.first(_says(at.isNotNull(), at, detail)).alias(f"_wait{i}") for i, (at, detail) in enumerate(waits)],
        *[F.count_if((t > at) & (t <= at + ALIVE_S)).alias(f"_live{i}") for i, (at, _) in enumerate(waits)],
    )
    facts = _closed(facts)
    talks = F.col("n_v2g") > 0
    open_end = talks & ~F.col("graceful_close")
    span = F.coalesce("cable_end", "last_cable") - F.col("cable_req")
    alive = [F.when(F.col(f"_live{i}") >= ALIVE_ROWS, F.col(f"_wait{i}")) for i in range(len(waits))]
    wait = F.col("first_v2g") - F.col("first_slac")
    phase = F.when(F.col("has_power"), "PowerDelivery").when(F.col("has_precharge"), "PreCharge").when(F.col("cable_req").isNotNull(), "CableCheck").otherwise("ChargeParameterDiscovery")
    unpowered = F.col("graceful_close") & F.col("first_cd").isNull() & F.col("param_req").isNotNull()
    facts = facts.withColumns({
        "stuck": _says(span > CABLE_STRICT_S, F.col("cable_req") + CABLE_STRICT_S, F.format_string("CableCheck stuck %.0fs", span)),
        "rematch": _says(talks & F.col("_rematch").isNotNull(), F.col("_rematch.prv"), F.lit("re-SLAC mid-session (link drop)")),
        "reset": _says(open_end & F.col("_reset").isNotNull(), F.col("_reset"), F.lit("TCP RST")),
        "unmatched": _says(~talks & (F.col("n_slac") >= 3), F.col("t_end"), F.format_string("SLAC attempts without V2G (%d frames)", "n_slac")),
        "slow": _says(wait > SLAC_SLOW_S, F.col("first_slac") + SLAC_SLOW_S, F.format_string("PLC pairing took %.0fs before V2G opened (fleet median 9s)", wait)),
        "no_power": _says(unpowered, F.coalesce("stop_req", "last_dc", "stop_res"), F.concat(F.lit("stopped after "), phase, F.lit(", never reached CurrentDemand"))),
        "silent": _says(open_end, F.col("t_end"), F.lit("stream death, no SessionStop")),
        "broken": F.when(open_end, F.array_min(F.array_compact(F.array("reopened", "_idle", "_slow", *alive)))),
    })
    return facts.select([c for c in facts.columns if not c.startswith("_")])


def quiet(evidence: DataFrame) -> DataFrame:
    """Sessions whose dialog has no graceful close and neither a matching request nor a reset that explains it."""
    return evidence.where("n_v2g > 0 AND NOT graceful_close AND rematch IS NULL AND reset IS NULL")


def _candidates(evidence: DataFrame, column: str, family: str) -> DataFrame:
    return _faults(evidence.where(F.col(column).isNotNull()), F.col(f"{column}.t"), family, F.col(f"{column}.detail"))


def cable_stuck(evidence: DataFrame) -> DataFrame:
    """Cable check longer than a minute: from its first request to the next pre-charge or power request, else to its last row."""
    return _candidates(evidence, "stuck", "COMM_FREEZE")


def delivery_stalls(evidence: DataFrame) -> DataFrame:
    """The first dialog gap of more than FREEZE_S between the first and last CurrentDemand row."""
    return _candidates(evidence, "stall", "COMM_FREEZE")


def slac_failures(evidence: DataFrame) -> DataFrame:
    """Matching without a dialog, at the session's end."""
    return _candidates(evidence, "unmatched", "SLAC_FAILURE")


def slow_pairing(evidence: DataFrame) -> DataFrame:
    """More than a minute from the first matching row to the dialog."""
    return _candidates(evidence, "slow", "SLAC_FAILURE")


def rematch_aborts(evidence: DataFrame) -> DataFrame:
    """A matching request well inside the dialog around which this session's own dialog broke; at the dialog row before it."""
    return _candidates(evidence, "rematch", "SESSION_ABORT")


def reset_aborts(evidence: DataFrame) -> DataFrame:
    """The first TCP reset at or after the dialog's begin on one of the dialog's own streams; not after a graceful close or a re-match."""
    return _candidates(evidence.where("rematch IS NULL"), "reset", "SESSION_ABORT")


def abort_evidence(evidence: DataFrame) -> DataFrame:
    """The earliest thing that shows a quiet session's dialog broke."""
    return _candidates(quiet(evidence), "broken", "SESSION_ABORT")


def legacy_aborts(evidence: DataFrame) -> DataFrame:
    """Every quiet session, at its end."""
    return _candidates(quiet(evidence), "silent", "SESSION_ABORT")


def no_power(evidence: DataFrame) -> DataFrame:
    """Charging was asked for, the dialog closed properly, and no current ever flowed."""
    return _candidates(evidence, "no_power", "NO_POWER_DELIVERED")


def alive_after(rows: DataFrame, candidates: DataFrame, window_s: float = ALIVE_S) -> DataFrame:
    """``candidates`` (session, at, ...) with alive_rows, the session's rows in (at, at + window_s].

    Rows and the two ends of each interval stand in one order by time, so the count is the difference of two
    running counts; nothing is joined by range. Candidates that repeat a session and time get one answer each.
    """
    ends = candidates.select(*SESSION, F.col("at").cast("double").alias("a"), (F.col("at") + window_s).cast("double").alias("b"))
    counts = interval_counts(rows, ends, window_s).select(*SESSION, F.col("a").alias("at"), F.col("n_after").alias("alive_rows"))
    return candidates.withColumn("at", F.col("at").cast("double")).join(counts, [*SESSION, "at"], "left").withColumn("alive_rows", F.coalesce("alive_rows", F.lit(0)))


def interval_counts(rows: DataFrame, intervals: DataFrame, most_gap_s: float) -> DataFrame:
    """For each distinct (session, a, b): n (rows in [a, b]), n_after (rows in (a, b]) and widest_ok (no gap beyond the limit, ends included)."""
    keys = intervals.select(*SESSION, F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).distinct()
    # at one instant a's mark stands before the rows (0), a's second mark and b's mark after them (2)
    marks = keys.select(*SESSION, "a", "b", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("o"), F.lit("a").alias("m")), F.struct(F.col("a").alias("t"), F.lit(2).alias("o"), F.lit("s").alias("m")), F.struct(F.col("b").alias("t"), F.lit(2).alias("o"), F.lit("b").alias("m")))).alias("x")).select(*SESSION, "a", "b", "x.*")
    null = F.lit(None)
    data = rows.select(*SESSION, null.cast("double").alias("a"), null.cast("double").alias("b"), F.col("t").cast("double").alias("t"), F.lit(1).alias("o"), F.lit("r").alias("m"))
    order = Window.partitionBy(*SESSION).orderBy("t", "o")
    back = Window.partitionBy(*SESSION).orderBy(F.desc("t"), F.desc("o"))
    row = F.col("m") == "r"
    line = data.unionByName(marks).withColumn("_p", F.last(_at(row), True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_f", F.last(_at(row), True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    wide = row & (F.col("t") - F.col("_p") > most_gap_s)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_n", F.sum(F.when(row, 1).otherwise(0)).over(upto)).withColumn("_w", F.sum(F.when(wide, 1).otherwise(0)).over(upto)).where(~row)
    side = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    found = line.groupBy(*SESSION, "a", "b").agg(*[side(m, c).alias(f"{m}{c}") for m in "asb" for c in ("_n", "_w", "_p", "_f")])
    first_in = F.col("a_f")
    # gaps that end in (first row inside, b] count; the first row's own gap begins before a
    inner = F.col("b_w") - F.col("a_w") - F.when(first_in - F.coalesce("a_p", first_in) > most_gap_s, 1).otherwise(0)
    ok = (F.col("b_n") > F.col("a_n")) & (inner <= 0) & (first_in - F.col("a") <= most_gap_s) & (F.col("b") - F.col("b_p") <= most_gap_s)
    return found.select(*SESSION, "a", "b", (F.col("b_n") - F.col("a_n")).alias("n"), (F.col("b_n") - F.col("s_n")).alias("n_after"), F.coalesce(ok, F.lit(False)).alias("widest_ok"))


def continuous(rows: DataFrame, candidates: DataFrame, least_rows: int, most_gap_s: float) -> DataFrame:
    """``candidates`` (session, a, b, ...) whose interval [a, b] has enough rows and no gap beyond the limit, its ends included."""
    real = candidates.where("b > a").withColumn("a", F.col("a").cast("double")).withColumn("b", F.col("b").cast("double"))
    ok = interval_counts(rows, real, most_gap_s).where((F.col("n") >= least_rows) & F.col("widest_ok")).select(*SESSION, "a", "b")
    return real.join(ok, [*SESSION, "a", "b"], "left_semi")


def decode_quality(rows: DataFrame) -> DataFrame:
    """(session, flag): the first physically impossible voltage or state of charge on rows that did not fail."""
    bad = [F.when((F.col(c) < 0) | (F.col(c) > 1000), F.format_string(f"DECODE_ERROR:{c}=%s", F.col(c).cast("string"))) for c in ("evse_v", "ev_target_v", "ev_max_v", "evse_max_v")]
    bad.append(F.when((F.col("soc") < 0) | (F.col("soc") > 100), F.format_string("DECODE_ERROR:soc=%s", F.col("soc").cast("string"))))
    flagged = rows.where(v2g() & ~S.is_failed(F.col("resp_code"))).withColumn("flag", F.coalesce(*bad)).where("flag IS NOT NULL")
    return flagged.groupBy(*SESSION).agg(F.min_by("flag", F.struct("t", "seq")).alias("flag"))


def strict_list(legacy_abort: bool = False) -> Column:
    """Of a row of evidence, the first fault of each family in time order."""
    abort = F.coalesce("rematch", "reset", "silent" if legacy_abort else "broken")
    rules = {f: F.col(f"stated_{f}") for f in _stated()}
    rules |= {"COMM_FREEZE": F.array_min(F.array_compact(F.array("stuck", "stall"))), "SESSION_ABORT": abort, "SLAC_FAILURE": F.coalesce("unmatched", "slow"), "NO_POWER_DELIVERED": F.col("no_power")}
    named = [F.when(c.isNotNull(), F.struct(c.t.alias("t"), F.lit(f).alias("family"), c.detail.alias("detail"))) for f, c in rules.items()]
    return F.array_sort(F.array_compact(F.array(*named)))


def strict_faults(evidence: DataFrame, legacy_abort: bool = False) -> DataFrame:
    """(session, t, family, detail): the first fault of each family under the strict profile."""
    found = is_session(evidence).select(*SESSION, F.explode(strict_list(legacy_abort)).alias("f"))
    return found.select(*SESSION, "f.t", "f.family", "f.detail")


def first_faults(candidates: DataFrame) -> DataFrame:
    """The first candidate of each family in a session."""
    return candidates.groupBy(*SESSION, "family").agg(F.min(F.struct("t", "detail")).alias("f")).select(*SESSION, "f.t", "family", "f.detail")


def with_first(out: DataFrame, profile: str) -> DataFrame:
    first = F.try_element_at("faults", F.lit(1))
    return out.withColumn("first_fault_t", first.t).withColumn("first_fault_family", first.family).withColumn("label_profile", F.lit(profile))


def assembled(facts: DataFrame, faults: DataFrame, profile: str) -> DataFrame:
    """The label table: facts, faults in time order, first fault, profile."""
    lists = faults.groupBy(*SESSION).agg(F.sort_array(F.collect_list(F.struct("t", "family", "detail"))).alias("faults"))
    out = is_session(facts).join(lists, list(SESSION), "left").withColumn("faults", F.coalesce("faults", F.expr(f"cast(array() as array<{FAULT}>)")))
    return with_first(out, profile)


def label_sessions(rows: DataFrame, profile: str = "strict") -> DataFrame:
    """Labels of all sessions in ``rows`` under a profile: strict, legacy or reviewed."""
    if profile not in ("strict", "legacy"):
        from . import reviewed

        return reviewed.label(rows)
    evidence = is_session(session_evidence(rows))
    out = evidence.withColumn("faults", strict_list(profile == "legacy"))
    return with_first(out, profile).withColumn("censored", F.lit(False)).withColumn("censor_reason", F.lit(""))
