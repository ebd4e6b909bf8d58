"""Scalar functions of telemetry rows, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def is_activity(kind: Column, msg: Column) -> Column:
    """Rows that keep a session alive: dialog rows and matching frames, not link polls."""
    matching = F.lit(False)
    for part in ("SLAC", "ATTEN_CHAR", "SET_KEY", "VALIDATE"):
        matching = matching | msg.contains(part)
    return kind.isin("v2g", "sdp", "tcp") | ((kind == "hpav") & matching)


def is_decision(kind: Column, msg: Column) -> Column:
    return ~((kind == "hpav") & msg.contains("LINK_STATUS"))


def is_opener(kind: Column, msg: Column) -> Column:
    return (kind == "v2g") & msg.isin(*K.OPENERS)


def msg_base(msg: Column) -> Column:
    return F.when(F.right(msg, F.lit(3)).isin("Req", "Res"), F.substring(msg, F.lit(1), F.length(msg) - 3)).otherwise(msg)


def msg_suffix(msg: Column) -> Column:
    return F.when(F.right(msg, F.lit(3)).isin("Req", "Res"), F.right(msg, F.lit(3))).otherwise("")


def stage_index(msg: Column) -> Column:
    """Place in the DC sequence from 0, null outside it."""
    return K.lookup({s: i for i, s in enumerate(K.DC_STAGES)}, msg_base(msg))


def phase_of(msg: Column) -> Column:
    """The phase that a dialog message belongs to, else null."""
    stems = {s: p for p, names in K.PHASE_STEMS.items() for s in names}
    return F.when(msg_suffix(msg) != "", K.lookup(stems, msg_base(msg)))


def is_failed(resp_code: Column) -> Column:
    return F.upper(F.coalesce(resp_code, F.lit(""))).startswith("FAILED")


def rc_severity(resp_code: Column) -> Column:
    return F.when(is_failed(resp_code), 1.0).when(F.upper(resp_code) == "OK_CERTIFICATEEXPIRESSOON", 0.5).otherwise(0.0)


def evse_severity(status: Column) -> Column:
    return K.lookup(K.EVSE_SEVERITY, status, 0.0)


def isolation_severity(isolation: Column) -> Column:
    return K.lookup(K.ISOLATION_SEVERITY, isolation, 0.0)


def notification_severity(notification: Column) -> Column:
    return K.lookup(K.NOTIFICATION_SEVERITY, notification, 0.0)


def ev_error_severity(ev_err: Column) -> Column:
    return F.when(F.coalesce(ev_err, F.lit("")).isin("", "NO_ERROR", "NoData"), 0.0).otherwise(1.0)


def validation_bad(validation: Column) -> Column:
    v = F.coalesce(validation, F.lit(""))
    return (v != "") & ~v.contains("OK") & ~v.contains("Success")


def truthy(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("1", "true", "yes")


def extra_get(extra: Column, key: str) -> Column:
    """A key of a JSON object as text; null where the key or valid JSON is missing."""
    return F.get_json_object(extra, f"$.{key}")


def extra_fields(extra: Column, **fields: str) -> dict[str, Column]:
    """Typed keys of a JSON object, which is parsed once as a variant for all of them: {name: column}. Null where the
    object is no valid JSON, the key is missing or its value is not of the type."""
    parsed = F.try_parse_json(extra)
    return {name: F.try_variant_get(parsed, f"$.{name}", kind) for name, kind in fields.items()}


def site_of(station: Column) -> Column:
    return F.regexp_replace(station, "^(2024|2025)__", "")


def station_group(station: Column) -> Column:
    return F.when(station.startswith("2024__"), "v2g2024").when(station.startswith("2025__"), "v2g2025").otherwise("main")


def display_name(station: Column) -> Column:
    """The site, with the year of its data set in brackets where it has one."""
    year = F.regexp_extract(station, "^(2024|2025)__", 1)
    return F.concat(site_of(station), F.when(year != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""))


def clock_year(median_start: Column) -> Column:
    """The year of a station's median session start, UTC; a clock is sane from 2024 to 2026."""
    return F.year(F.timestamp_seconds(median_start))


def clock_is_sane(median_start: Column) -> Column:
    return clock_year(median_start).between(2024, 2026)


def severity_for(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "critical").when(confidence >= 0.85, "high").when(confidence >= 0.70, "medium").otherwise("low")


def health_band(score: Column) -> Column:
    return F.when(score.isNull(), "no_data").when(score >= 85, "healthy").when(score >= 70, "watch").when(score >= 50, "plan_service").otherwise("urgent")


def policy_arm(policy: Column) -> Column:
    """The arm of a detection policy; an unknown policy is an error."""
    return F.when(policy.isin("baseline", "iso15118-standard"), policy).otherwise(F.raise_error(F.concat(F.lit("unknown policy "), F.coalesce(policy, F.lit("null")))))


def research_arm(iso2_rules: Column, slac_mode: Column) -> Column:
    """The arm of a research grid that a policy's rule layers belong to; null for a combination that no grid has."""
    mode = F.lower(F.trim(F.coalesce(slac_mode, F.lit(""))))
    off, normative, empirical = mode.isin("", "off"), mode == "normative", mode == "empirical"
    return F.when(iso2_rules & off, "iso2").when(iso2_rules & normative, "iso2normative").when(~iso2_rules & off, "baseline").when(~iso2_rules & (normative | empirical), mode)


def percent_of(part: Column, whole: Column) -> Column:
    """One decimal in per cent as text, of two counts; null where the whole is 0. Decided in integers: halves go up."""
    part, whole = part.cast("bigint"), F.when(whole != 0, whole.cast("bigint"))
    tenths = F.call_function("div", 2000 * part + whole, 2 * whole)
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


# fixed values: ordered groups of alert reasons, the first pattern that matches wins
REASON_BUCKETS = (
    ("ISO Ongoing timer [V2G2-711/713]", r"V2G2-711|EVSEProcessing Ongoing|Ongoing \d"),
    ("ISO sequence timer [V2G2-443]", r"V2G2-443|sequence idle|no request for"),
    ("ISO comm setup [V2G2-448]", r"V2G2-448|SessionSetupRes within|setup \d+s/20s"),
    ("ISO CableCheck [V2G2-702]", r"V2G2-702|CableCheck \d+s/40s"),
    ("ISO PreCharge [V2G2-706]", r"V2G2-706|PreCharge [\d.]+s/7s"),
    ("ISO re-dialog [8.8.1]", r"dialog reopened"),
    ("ISO sequence legality [Fig.102]", r"Fig\.102|legal successor"),
    ("ISO message timeout [Table 109]", r"Table 109"),
    ("ISO response/status semantics", r"ISO 8\.8\.3|ISO Table 98|ISO 8\.5"),
    ("baseline rule: ResponseCode", r"rule: ResponseCode|resp FAILED|resp \w*FAILED"),
    ("baseline rule: EVSE status", r"rule: EVSE_|EVSE_Malfunction|EVSE_EmergencyShutdown"),
    ("baseline rule: isolation", r"isolation Fault|insulation"),
    ("baseline rule: EV error", r"EVErrorCode|EVError "),
    ("baseline rule: cablecheck 40s", r"CableCheck > 40s|cablecheck \d"),
    ("baseline rule: dialog gap", r"msg gap|dialog gap|dt_v2g"),
    ("baseline rule: PLC/SLAC/TCP", r"SLAC|PLC link|TCP RST|retx"),
    ("baseline rule: electrical", r"V above EV max|V over EV|I collapse|precharge gap|ripple"),
    ("learned: xgboost", r"^xgb|xgb:"),
    ("learned: isolation forest", r"iforest"),
    ("learned: RL policy", r"^policy:|Q\(alert\)"),
    ("learned: autoencoder / forecast", r"AE z=|forecast z=|belief .*AE"),
    ("agent: investigation", r"investigation '"),
    ("agent: goal failure", r"goal '"),
    ("agent: belief fusion", r"^belief "),
    ("multi-agent: consensus", r"consensus \["),
    ("multi-agent: critical", r"critical:"),
)


def reason_bucket(reason: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in REASON_BUCKETS:
        out = out.when(reason.rlike(f"(?i){pattern}"), name)
    return out.otherwise("other")
