"""Detectors: functions from feature rows to alerts, and the first alert of each session and detector."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from .features import ewm, v2g
from .sessions import SESSION, UP_TO, per


DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_detector(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """``fn`` takes feature rows and returns rows with an ``alert`` struct (confidence, reason, fault_guess), null where it is silent."""
    DETECTORS[name] = fn


def _alert(confidence: float, reason: Column, family: str) -> Column:
    return F.struct(F.lit(confidence).alias("confidence"), reason.alias("reason"), F.lit(family).alias("fault_guess"))


def _first(*rules: tuple[Column, float, Column, str]) -> Column:
    """The alert of the first rule that holds."""
    out = F.when(rules[0][0], _alert(*rules[0][1:]))
    for condition, *alert in rules[1:]:
        out = out.when(condition, _alert(*alert))
    return out


def spec_rules(rows: DataFrame) -> DataFrame:
    """Hard markers and physical limits, in order; needs the tracked features."""
    say = F.lit
    return rows.withColumn("alert", _first(
        (S.is_failed(F.col("resp_code")), 1.0, F.concat(say("rule: ResponseCode "), "resp_code"), "PROTOCOL_FAILED"),
        (F.col("evse_status").isin("EVSE_Malfunction", "EVSE_EmergencyShutdown"), 1.0, F.concat(say("rule: "), "evse_status"), "EVSE_FAULT"),
        (F.col("isolation") == "Fault", 1.0, say("rule: isolation Fault"), "ISOLATION_FAULT"),
        (~F.col("ev_err").isin("", "NO_ERROR"), 1.0, F.concat(say("rule: EVErrorCode "), "ev_err"), "EV_ERROR"),
        (F.col("cablecheck_elapsed") > 40, 0.9, say("rule: CableCheck > 40s (spec)"), "COMM_FREEZE"),
        ((F.col("phase") == "delivery") & (F.col("dt_v2g") > 3.5), 0.85, F.format_string("rule: msg gap %.1fs in delivery", "dt_v2g"), "COMM_FREEZE"),
        (F.col("v_over"), 0.9, say("rule: V above EV max limit"), "EVSE_FAULT"),
        (F.col("retx_60s") > 60, 0.7, F.format_string("rule: %d retx/60s", "retx_60s"), "SESSION_ABORT"),
        ((F.col("link_gap") > 3) & (F.col("phase") != "idle"), 0.75, F.format_string("rule: PLC link silent %.1fs", "link_gap"), "SESSION_ABORT"),
        (F.col("slac_attempts") >= 3, 0.8, say("rule: 3+ SLAC attempts"), "SLAC_FAILURE"),
        (F.col("rst_seen") & F.col("phase").isin("delivery", "cablecheck", "precharge"), 0.8, say("rule: TCP RST mid-session"), "SESSION_ABORT"),
    ))


def conformance_rules(rows: DataFrame) -> DataFrame:
    """The standard's own error criteria and timers, in order; needs the conformance features."""
    say = F.lit
    redialog = F.greatest(F.col("dialog") - 1, F.lit(0))
    return rows.withColumn("alert", _first(
        (F.col("rc_sev") >= 1, 1.0, F.format_string("ISO 8.8.3: ResponseCode %s -> terminate", "resp_code"), "PROTOCOL_FAILED"),
        (F.col("evse_sev") >= 1, 1.0, F.concat(say("ISO Table 98: "), "evse_status"), "EVSE_FAULT"),
        (F.col("isolation_sev") >= 1, 1.0, say("ISO 8.5: EVSEIsolationStatus Fault"), "ISOLATION_FAULT"),
        (F.col("ev_err_sev") >= 1, 1.0, F.concat(say("ISO 8.5: EVErrorCode "), "ev_err"), "EV_ERROR"),
        (F.col("ongoing_s") >= K.ONGOING_PERFORMANCE_S, 0.95, F.format_string("[V2G2-711] EVSEProcessing Ongoing %.0fs (timeout 60s)", "ongoing_s"), "COMM_FREEZE"),
        (F.col("seq_gap_s") >= K.SEQ_TIMEOUT_S, 0.95, F.format_string("[V2G2-443] no request for %.0fs (V2G_SECC_Sequence_Timeout 60s)", "seq_gap_s"), "COMM_FREEZE"),
        (F.col("comm_setup_s") >= K.COMM_SETUP_TIMEOUT_S, 0.9, say("[V2G2-448] no SessionSetupRes within 20s of link-up"), "SESSION_ABORT"),
        (F.col("cablecheck_open") & (F.col("cablecheck_s") >= K.CABLECHECK_TIMEOUT_S), 0.9, F.format_string("[V2G2-702] CableCheck %.0fs (timeout 40s)", "cablecheck_s"), "COMM_FREEZE"),
        (redialog >= 1, 0.85, F.format_string("ISO 8.8.1: dialog reopened %dx (previous session was terminated)", redialog), "SESSION_ABORT"),
        (F.col("msg_timeout_ratio") >= 1, 0.8, F.format_string("Table 109: request unanswered for %.1fx its timeout", "msg_timeout_ratio"), "COMM_FREEZE"),
    ))


def matching_rules(rows: DataFrame, mode: str = "empirical", wait_s: float = K.MATCH_TIMEOUT_S) -> DataFrame:
    """Matching that failed before any dialog; modes empirical, normative, both. Needs the matching features."""
    if mode not in ("empirical", "normative", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    alone = ~F.col("v2g_seen")
    rules = []
    if mode != "empirical":
        rules.append((alone & F.col("match_pending") & (F.col("match_pending_s") >= K.NORMATIVE_MATCH_S), 0.95, F.format_string("SLAC_MATCH.REQ unanswered for %.0fms (3 x TT_match_response = 600ms), no V2G", F.col("match_pending_s") * 1000), "SLAC_FAILURE"))
        rules.append((alone & F.col("awaiting") & (F.col("awaiting_s") >= K.MATCH_SESSION_S), 0.9, F.format_string("no VALIDATE.REQ/SLAC_MATCH.REQ for %.1fs after ATTEN_CHAR.RSP, no V2G", "awaiting_s"), "SLAC_FAILURE"))
    if mode != "normative":
        rules.append((alone & F.col("match_pending") & (F.col("match_pending_s") >= wait_s), 0.9, F.format_string("SLAC fleet policy: SLAC_MATCH.REQ unanswered for %.1fs, no V2G", "match_pending_s"), "SLAC_FAILURE"))
    return rows.withColumn("alert", _first(*rules))


def reflex_goals(rows: DataFrame) -> DataFrame:
    """Goals that must hold at every row (fixed values: texts and limits): dialog, charger, insulation and vehicle
    healthy, the link matched, and three of the standard's timers. Needs conformance and matching features."""
    say, c = F.lit, F.col
    hit = _matching_confidence("empirical")
    setup = c("comm_setup_s") / K.COMM_SETUP_TIMEOUT_S
    return rows.withColumn("alert", _first(
        (S.is_failed(c("resp_code")), 1.0, F.concat(say("goal 'dialog OK' failed: "), "resp_code"), "PROTOCOL_FAILED"),
        (c("evse_status").isin(*HARD), 1.0, F.concat(say("goal 'EVSE healthy' failed: "), "evse_status"), "EVSE_FAULT"),
        (c("isolation") == "Fault", 1.0, say("goal 'insulation OK' failed"), "ISOLATION_FAULT"),
        (~c("ev_err").isin("", "NO_ERROR"), 1.0, F.concat(say("goal 'EV healthy' failed: "), "ev_err"), "EV_ERROR"),
        (~c("v2g_seen") & hit.isNotNull(), 1.0, F.format_string("goal 'PLC link established' failed: SLAC_MATCH.REQ unanswered for %.1fs, no V2G", "match_pending_s"), "SLAC_FAILURE"),
        (c("ongoing_ratio") >= 1, 1.0, F.format_string("goal 'EVSE finishes processing' failed: Ongoing %.0fs > 60s [V2G2-711]", "ongoing_s"), "COMM_FREEZE"),
        (c("seq_timeout_ratio") >= 1, 1.0, F.format_string("goal 'dialog progresses' failed: idle %.0fs > 60s [V2G2-443]", "seq_gap_s"), "COMM_FREEZE"),
        (setup >= 1, 1.0, say("goal 'session established' failed: no SessionSetupRes within 20s [V2G2-448]"), "SESSION_ABORT"),
    ))


def first_alerts(rows: DataFrame, detector: str) -> DataFrame:
    """(session, detector, t, confidence, reason, fault_guess): the first row of each session at which the detector speaks."""
    first = rows.where("alert IS NOT NULL").groupBy(*SESSION).agg(F.min(F.struct("t", "seq", "alert")).alias("a"))
    return first.select(*SESSION, F.lit(detector).alias("detector"), "a.t", "a.alert.confidence", "a.alert.reason", "a.alert.fault_guess")


def all_first_alerts(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """First alerts of the named (or all registered) detectors, which all read one pass over the rows."""
    names = list(names or DETECTORS)
    for i, name in enumerate(names):
        rows = DETECTORS[name](rows).withColumnRenamed("alert", f"_alert{i}")
    firsts = [F.min(F.when(F.col(f"_alert{i}").isNotNull(), F.struct("t", "seq", F.col(f"_alert{i}").alias("alert")))).alias(f"_a{i}") for i in range(len(names))]
    each = [F.when(F.col(f"_a{i}").isNotNull(), F.struct(F.lit(name).alias("detector"), F.col(f"_a{i}.t").alias("t"), F.col(f"_a{i}.alert").alias("alert"))) for i, name in enumerate(names)]
    found = rows.groupBy(*SESSION).agg(*firsts).select(*SESSION, F.explode(F.array_compact(F.array(*each))).alias("f"))
    return found.select(*SESSION, "f.detector", "f.t", "f.alert.confidence", "f.alert.reason", "f.alert.fault_guess")


def cadence(rows: DataFrame, every: int = 4) -> DataFrame:
    """The dialog rows at which models score: every so many of a session."""
    return rows.where(v2g()).withColumn("_n", F.row_number().over(per(*SESSION))).where(F.col("_n") % every == 0).drop("_n")


def _strongest(*posts: Column) -> Column:
    """The greatest weight posted to a family at a row, null without any."""
    return F.greatest(*posts, F.lit(None).cast("double"))


HARD = ("EVSE_Malfunction", "EVSE_EmergencyShutdown")


def evidence_posts(rows: DataFrame, conformance: bool = True, matching: bool = True) -> dict[str, Column]:
    """Weights by evidence family at a row, null without evidence (fixed values: families, limits and weights).

    Needs the tracked features, the smoothed ones for ripple and latency, and those of the conformance and matching
    tools that are on. Electrical trends count on rows that measure, link health on link rows and during delivery.
    """
    c, when, upto = F.col, F.when, lambda x, top: F.least(x, F.lit(top))
    z = lambda name: c(name) if name in rows.columns else F.lit(0.0)
    posts: dict[str, list[Column]] = {f: [] for f in ("protocol", "evse", "isolation", "ev", "timeout", "power", "comm", "battery")}
    delivery = c("phase") == "delivery"
    busy = c("phase").isin("cablecheck", "precharge", "delivery")
    # what the dialog states
    posts["protocol"] += [when(S.is_failed(c("resp_code")), 1.0), when(S.validation_bad(c("validation")), 0.3), when(delivery & c("notification").isin("Stop", "StopCharging"), 0.35)]
    posts["evse"] += [when(c("evse_status").isin(*HARD), 1.0)]
    posts["isolation"] += [when(c("isolation") == "Fault", 1.0), when(c("isolation") == "Warning", 0.55)]
    posts["ev"] += [when(~c("ev_err").isin("", "NO_ERROR"), 1.0)]
    posts["timeout"] += [when(c("cablecheck_elapsed") > 30, when(c("cablecheck_elapsed") < 40, 0.5).otherwise(0.9)), when(c("precharge_elapsed") > 7, 0.6)]
    # trends
    trend = v2g() & (c("evse_v").isNotNull() | c("evse_i").isNotNull())
    posts["power"] += [when(trend & c("v_over"), 0.9), when(trend & (c("collapse_run") >= 60), 0.6), when(trend & ((F.abs(z("v_ripple_z")) > 8) | (F.abs(z("i_ripple_z")) > 8)), 0.25)]
    stalled = delivery & (c("soc_rate") <= 0) & (c("evse_i") > 30) & (c("session_elapsed") > 120)
    posts["battery"] += [when(trend & (c("remaining_trend") > 5), 0.3), when(trend & stalled, 0.45)]
    # link health
    link = c("kind").isin("tcp", "hpav") | delivery
    attempts = F.least(c("slac_attempts") - 2, F.lit(2))
    posts["comm"] += [
        when(link & (c("retx_60s") > 12), upto(0.1 + 0.015 * c("retx_60s"), 0.6)), when(link & (c("link_gap") > 2) & (c("phase") != "idle"), upto(0.4 + 0.1 * c("link_gap"), 0.9)),
        when(link & (c("slac_attempts") >= 2), 0.5 + 0.2 * attempts), when(link & c("rst_seen") & busy, 0.8),
        when(delivery & (c("dt_v2g") > 1.5), upto(0.2 + 0.15 * c("dt_v2g"), 0.8)), when(link & (z("latency_z") > 6) & (c("req_res_latency") > 0.1), 0.35),
    ]
    if conformance:
        setup = c("comm_setup_s") / K.COMM_SETUP_TIMEOUT_S
        again = F.greatest(c("dialog") - 1, F.lit(0))
        posts["timeout"] += [
            when(c("ongoing_ratio") > 0.25, upto(0.3 + 0.7 * c("ongoing_ratio"), 0.97)), when(c("seq_timeout_ratio") > 0.25, upto(0.2 + 0.8 * c("seq_timeout_ratio"), 0.95)),
            when(c("cablecheck_ratio") > 0.6, upto(0.3 + 0.6 * c("cablecheck_ratio"), 0.92)), when(c("msg_timeout_ratio") >= 1, 0.8),
        ]
        posts["power"] += [when((c("precharge_ratio") > 0.7) & (c("precharge_v_gap_ratio") > 1), upto(0.3 + 0.4 * c("precharge_ratio"), 0.85))]
        posts["protocol"] += [when(setup > 0.5, upto(0.2 + 0.7 * setup, 0.9)), when(c("seq_illegal"), 0.7), when(again > 0, upto(0.6 + 0.2 * again, 0.9))]
        posts["evse"] += [when(c("evse_sev") >= 1, 1.0)]
    if matching:
        alone = ~c("v2g_seen")
        hit = _matching_confidence("empirical")
        posts["comm"] += [when(alone, F.when(hit.isNotNull(), F.greatest(hit, F.lit(0.96))).when(c("match_pending_s") >= 1, 0.45)), when(alone & (c("n_restart") >= 1), 0.5 + 0.15 * F.least(c("n_restart"), F.lit(3)))]
    return {f: _strongest(*p) if len(p) > 1 else p[0] for f, p in posts.items()}


def _matching_confidence(mode: str, wait_s: float = K.MATCH_TIMEOUT_S) -> Column:
    pending = F.col("match_pending") & (F.col("match_pending_s") >= (wait_s if mode == "empirical" else K.NORMATIVE_MATCH_S))
    out = F.when(pending, 0.9 if mode == "empirical" else 0.95)
    return out if mode == "empirical" else out.when(F.col("awaiting") & (F.col("awaiting_s") >= K.MATCH_SESSION_S), 0.9)


LENSES = ("power", "battery", "protocol", "comms", "standards")


def lens_posts(rows: DataFrame, gain: float = 1.0, matching: bool = True) -> dict[str, Column]:
    """Suspicion that each lens posts at a row, null for none (fixed values: lenses, limits, weights and caps).

    ``gain`` sharpens the evidence of rules that have a cap, up to the cap; a rule without one keeps its own weight.
    """
    c = F.col
    z = lambda name: c(name) if name in rows.columns else F.lit(0.0)

    def rule(when: Column, weight, cap: float | None = None) -> Column:
        weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        sharp = weight if cap is None else F.least(weight * gain, F.lit(cap))
        return F.when(when, F.least(sharp, F.lit(1.0)))

    delivery, busy = c("phase") == "delivery", c("phase").isin("cablecheck", "precharge", "delivery")
    unit = lambda name: F.least(c(name), F.lit(1.0))
    setup = c("comm_setup_s") / K.COMM_SETUP_TIMEOUT_S
    again = F.greatest(c("dialog") - 1, F.lit(0))
    new_attempt = (c("kind") == "hpav") & c("msg").contains("SLAC_PARM.REQ") & (c("slac_attempts") >= 2)
    found = {
        "power": [
            rule(c("v_over"), 0.95), rule(c("evse_i").isNotNull() & (c("collapse_run") >= 60), 0.6),
            rule(F.abs(z("v_ripple_z")) > 8, 0.15 + 0.03 * F.abs(z("v_ripple_z")), 0.45), rule(F.abs(z("i_ripple_z")) > 8, 0.15 + 0.03 * F.abs(z("i_ripple_z")), 0.45),
            rule(c("precharge_elapsed") > 7, 0.4 + 0.05 * c("precharge_elapsed"), 0.85), rule((c("precharge_elapsed") > 4) & (F.abs("precharge_v_gap") > 60), 0.55),
        ],
        "battery": [rule(~c("ev_err").isin("", "NO_ERROR"), 1.0), rule(delivery & (c("soc_rate") <= 0) & (c("evse_i") > 30) & (c("session_elapsed") > 120), 0.5), rule(c("remaining_trend") > 5, 0.3)],
        "protocol": [
            rule(S.is_failed(c("resp_code")), 1.0), rule(c("evse_status").isin(*HARD), 1.0), rule(c("isolation") == "Fault", 1.0), rule(c("isolation") == "Warning", 0.45),
            rule(S.validation_bad(c("validation")), 0.3), rule(delivery & c("notification").isin("Stop", "StopCharging"), 0.45), rule(c("cablecheck_elapsed") > 25, 0.4 + 0.02 * c("cablecheck_elapsed"), 0.9),
            rule(delivery & (c("dt_v2g") > 1.5), 0.2 + 0.15 * c("dt_v2g"), 0.8), rule((z("latency_z") > 5) & (c("req_res_latency") > 0.1), 0.4),
        ],
        "comms": [
            rule(new_attempt & c("v2g_seen"), 0.95), rule(new_attempt & ~c("v2g_seen"), 0.3 + 0.1 * c("slac_attempts"), 0.6),
            rule((c("link_gap") > 1.5) & (c("phase") != "idle"), 0.35 + 0.15 * c("link_gap"), 0.9), rule(c("retx_60s") > 12, 0.1 + 0.015 * c("retx_60s"), 0.6), rule(c("rst_seen") & busy, 0.75),
        ],
        "standards": [
            rule(c("rc_sev") >= 1, 1.0), rule(c("evse_sev") >= 1, 1.0), rule(c("ongoing_ratio") > 0.25, 0.3 + 0.7 * unit("ongoing_ratio"), 0.97), rule(c("seq_timeout_ratio") > 0.25, 0.2 + 0.8 * unit("seq_timeout_ratio"), 0.95),
            rule(c("cablecheck_ratio") > 0.6, 0.3 + 0.6 * unit("cablecheck_ratio"), 0.92), rule(setup > 0.5, 0.2 + 0.7 * F.least(setup, F.lit(1.0)), 0.9),
            rule(again > 0, 0.6 + 0.2 * again, 0.9), rule(c("seq_illegal"), 0.7), rule(c("msg_timeout_ratio") >= 1, 0.8),
        ],
    }
    if matching:
        hit = _matching_confidence("empirical")
        found["comms"].append(F.when(~c("v2g_seen") & hit.isNotNull(), F.greatest(hit, F.lit(0.95))))
    return {lens: F.greatest(*rules) for lens, rules in found.items()}


def lens_suspicions(rows: DataFrame, half_life_s: float = 15.0) -> DataFrame:
    """``rows`` with suspicion_<lens>: each lens's decayed suspicion without focus, by the board's running maximum."""
    frame = per(*SESSION).rowsBetween(*UP_TO)
    rows = rows.withColumn("_t0", F.col("t") - F.min("t").over(frame)).withColumns({f"_w_{n}": w for n, w in lens_posts(rows).items()})
    kept = {f"_p_{n}": F.max(F.when(F.col(f"_w_{n}") > 0, F.log2(f"_w_{n}") + F.col("_t0") / half_life_s)).over(frame) for n in LENSES}
    rows = rows.withColumns(kept)
    now = {f"suspicion_{n}": F.coalesce(F.pow(F.lit(2.0), F.col(f"_p_{n}") - F.col("_t0") / half_life_s), F.lit(0.0)) for n in LENSES}
    return rows.withColumns(now).drop("_t0", *[f"_w_{n}" for n in LENSES], *kept)


# fixed values: the detection policies, and which rule layers each has
POLICIES = {"baseline": {"iso2": False, "slac": "off"}, "iso15118-standard": {"iso2": True, "slac": "normative"}}


def detect_under_policies(rows: DataFrame, policies: dict[str, dict] | None = None) -> DataFrame:
    """(policy, session, t, confidence, reason, fault_guess): first alerts of the rule layers under each policy.

    The layers are computed once on the rows; a policy only chooses whose alert counts, so another policy costs an
    aggregate and no further pass. Needs tracked, conformance and matching features.
    """
    policies = policies or POLICIES
    layers = {"spec": spec_rules(rows), "iso2": conformance_rules(rows)} | {m: matching_rules(rows, m) for m in ("empirical", "normative", "both")}
    out = None
    for name, policy in policies.items():
        if policy["slac"] not in ("off", "empirical", "normative", "both"):
            raise ValueError(f"unknown matching mode {policy['slac']!r} of policy {name!r}")
        on = ["spec"] + (["iso2"] if policy["iso2"] else []) + ([policy["slac"]] if policy["slac"] != "off" else [])
        parts = reduce(DataFrame.unionByName, [layers[x].where("alert IS NOT NULL").select(*SESSION, "t", "seq", F.lit(i).alias("layer"), "alert") for i, x in enumerate(on)])
        first = parts.groupBy(*SESSION).agg(F.min(F.struct("t", "seq", "layer", "alert")).alias("a")).select(F.lit(name).alias("policy"), *SESSION, "a.t", "a.alert.*")
        out = first if out is None else out.unionByName(first)
    return out


def evidence_board(rows: DataFrame, posts: dict[str, Column], half_life_s: float = 20.0, alert_belief: float = 0.85, critical: float = 0.95) -> DataFrame:
    """belief, n_active, is_critical and alert from decaying evidence.

    All weights of a family decay at one rate, so the post that stands at a row is the one with the greatest
    log2(weight) + t / half-life so far, the later of equals: a running maximum.
    """
    frame = per(*SESSION).rowsBetween(*UP_TO)
    rows = rows.withColumn("_t0", F.col("t") - F.min("t").over(per(*SESSION).rowsBetween(*UP_TO)))
    keep, active, hard = F.lit(1.0), F.lit(0), F.lit(False)
    names = []
    for name, weight in posts.items():
        rows = rows.withColumn(f"_w_{name}", weight)
        w = F.col(f"_w_{name}")
        post = F.when(w > 0, F.struct((F.log2(w) + F.col("_t0") / half_life_s).alias("s"), F.col("_t0").alias("t"), w.alias("w")))
        rows = rows.withColumn(f"_p_{name}", F.max(post).over(frame))
        names.append(name)
    for name in names:
        now = F.coalesce(F.pow(F.lit(2.0), F.col(f"_p_{name}.s") - F.col("_t0") / half_life_s), F.lit(0.0))
        on = now >= 0.05
        keep = keep * F.when(on, 1 - F.least(now, F.lit(0.99))).otherwise(1.0)
        active = active + F.when(on, 1).otherwise(0)
        hard = hard | (on & (F.col(f"_p_{name}.w") >= critical))
    rows = rows.withColumn("belief", 1 - keep).withColumn("n_active", active).withColumn("is_critical", F.coalesce(hard, F.lit(False)))
    speaks = F.col("is_critical") | ((F.col("belief") >= alert_belief) & (F.col("n_active") >= 2))
    alert = F.struct(F.least("belief", F.lit(0.99)).alias("confidence"), F.format_string("belief %.2f", "belief").alias("reason"), F.lit("").alias("fault_guess"))
    return rows.withColumn("alert", F.when(speaks, alert)).drop("_t0", *[f"_w_{n}" for n in names], *[f"_p_{n}" for n in names])


def station_baselines(sessions: DataFrame, value: str, alpha: float = 0.25, default: float | str = 1.0, least: int = 3, keys: tuple[str, ...] = ("station", "connector")) -> DataFrame:
    """``sessions`` (``keys``, t_start, healthy, value) with expected: mean + 3 sigma + 0.25 |mean| of the
    smoothed healthy sessions of the same ``keys`` before this one, all of them, not under default / 2; default (a number or a
    column) until there are ``least`` sessions, healthy or not, and a healthy one among them. Null values are not learned.
    """
    place = Window.partitionBy(*keys).orderBy("t_start", *[c for c in SESSION if c in sessions.columns])
    otherwise = F.col(default) if isinstance(default, str) else F.lit(default)
    rows = sessions.withColumn("t", F.col("t_start")).withColumn("seq", F.row_number().over(place))
    rows = ewm(rows.withColumn("_healthy", F.when(F.col("healthy"), F.col(value))), "_healthy", "_b", *keys, alpha=alpha)
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("_b_mean").isNotNull(), F.struct(F.col("_b_mean").alias("m"), F.col("_b_var").alias("v"))), True).over(before)
    rows = rows.withColumn("_s", state)
    learned = F.greatest(F.col("_s.m") + 3 * F.sqrt("_s.v") + 0.25 * F.abs("_s.m"), otherwise / 2)
    known = (F.col("seq") > least) & F.col("_s").isNotNull()
    return rows.withColumn("expected", F.when(known, learned).otherwise(otherwise)).select(*sessions.columns, "expected")


# fixed values: what is learned of a connector, what is expected until then, and how fast it adapts
LEARNED = {"slac_s": (12.0, 0.25), "handshake_s": (25.0, 0.25), "cablecheck_s": (25.0, 0.25), "precharge_s": (6.0, 0.25), "mean_ripple": (None, 0.15), "mean_latency": (None, 0.15)}


def station_expectations(observed: DataFrame) -> DataFrame:
    """One row per session of ``observed`` (session, t_start, healthy and the columns of LEARNED): session and expected_<name>.

    The series of a connector are stacked, so one recurrence by (connector, series) learns all that adapt alike. Durations of 0 are not
    learned. Each session sees what the connector's sessions before it have taught, never itself.
    """
    known = {n: F.when(F.col(n) > 0, F.col(n)) if default is not None else F.col(n) for n, (default, _) in LEARNED.items()}
    entry = lambda n, x: F.struct(F.lit(n).alias("n"), x.cast("double").alias("x"), F.lit(LEARNED[n][0]).cast("double").alias("d"))
    out = None
    for alpha in sorted({a for _, a in LEARNED.values()}):
        stacked = F.explode(F.array(*[entry(n, x) for n, x in known.items() if LEARNED[n][1] == alpha]))
        long = observed.select(*SESSION, "t_start", "healthy", stacked.alias("e")).select(*SESSION, "t_start", "healthy", F.col("e.n").alias("series"), "e.x", "e.d")
        part = station_baselines(long, "x", alpha, "d", keys=("station", "connector", "series"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*SESSION).agg(*[F.max(F.when(F.col("series") == n, F.col("expected"))).alias(f"expected_{n}") for n in LEARNED])


register_detector("Spec", spec_rules)
register_detector("Conformance", conformance_rules)
register_detector("Matching", matching_rules)
register_detector("Reflex", reflex_goals)
register_detector("Board", lambda rows: evidence_board(rows, evidence_posts(rows)))
