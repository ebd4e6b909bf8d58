"""The fault catalogue: which family a finding belongs to, and what it means to the person who reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: families with the party that stops the session
STOP_PARTY = {
    "PROTOCOL_FAILED": "unknown", "EVSE_FAULT": "evse", "ISOLATION_FAULT": "evse", "EV_ERROR": "ev",
    "SLAC_FAILURE": "shared", "SESSION_ABORT": "unknown", "COMM_FREEZE": "unknown", "NO_POWER_DELIVERED": "unknown",
}
# fixed values: ordered patterns of reasons and the family that each hints at
FAMILY_HINTS = (
    (r"goal 'evse healthy' failed|evse_malfunction|evse_emergencyshutdown", "EVSE_FAULT"),
    (r"goal 'insulation ok' failed|isolation.?fault", "ISOLATION_FAULT"),
    (r"goal 'ev healthy' failed|everrorcode", "EV_ERROR"),
    (r"goal 'dialog ok' failed|failed response", "PROTOCOL_FAILED"),
    (r"no sessionsetupres|v2g2-448|tcp rst|re-slac mid-session", "SESSION_ABORT"),
    (r"link_establishment_failing|slac attempts|slac_failure", "SLAC_FAILURE"),
    (r"v2g2-443|v2g2-711|dialog_freezing|communication freeze|cablecheck.*stuck", "COMM_FREEZE"),
    (r"(?:never reached|no) currentdemand", "NO_POWER_DELIVERED"),
)
# fixed values: (families, pattern of the reason, party) that say more than the family does
REASON_PARTY = (
    (("PROTOCOL_FAILED",), r"SessionStopRes.*FAILED_SequenceError", "shared"),
    (("PROTOCOL_FAILED",), r"Failed_NoNegotiation", "shared"),
    (("EV_ERROR",), r"ChargingCurrentdifferential", "ev"),
    (("EV_ERROR",), r"ChargerConnectorLockFault", "ev"),
    (("SESSION_ABORT",), r"no SessionSetupRes", "evse"),
    (("SESSION_ABORT",), r"re-SLAC", "shared"),
    (("COMM_FREEZE", "SESSION_ABORT"), r"no further request", "ev"),
    (("COMM_FREEZE", "SESSION_ABORT"), r"EVSEProcessing.*Ongoing", "shared"),
    (("COMM_FREEZE", "SESSION_ABORT"), r"CableCheck stuck", "shared"),
)
# our own wording, in English; a caller may pass a table in another language
ENGLISH = {
    "PROTOCOL_FAILED": ("A response failed", "The charger answered a request with a FAILED code.", "DIN SPEC 70121 / ISO 15118-2, response codes"),
    "EVSE_FAULT": ("The charger reports a fault", "The charger's status says malfunction or emergency shutdown.", "DIN SPEC 70121 / ISO 15118-2, EVSE status; IEC 61851-23"),
    "ISOLATION_FAULT": ("Insulation fault", "The insulation monitor found the resistance to earth too low.", "IEC 61851-23, insulation monitoring"),
    "EV_ERROR": ("The vehicle reports an error", "The vehicle sent an error code with its status.", "DIN SPEC 70121 / ISO 15118-2, EV error codes"),
    "SLAC_FAILURE": ("No powerline match", "Vehicle and charger did not pair over the control pilot, so no dialog began.", "ISO 15118-3, signal level attenuation characterisation"),
    "SESSION_ABORT": ("The session broke off", "The dialog ended without its closing messages.", "ISO 15118-2, session stop"),
    "COMM_FREEZE": ("Communication froze", "A message or a phase took longer than its timer allows.", "ISO 15118-2, timers of table 109 and the sequence timer"),
    "NO_POWER_DELIVERED": ("No power delivered", "The dialog closed in order but current never flowed.", "ISO 15118-2, charging loop"),
}
UNKNOWN = ("Unclassified finding", "The evidence fits no known family.", "Compare the packets with the standard before judging")


def resolve_family(family: Column, reason: Column) -> Column:
    """The family if it is known, else the first that the reason hints at, else the family in capitals; null for blank text."""
    name = F.nullif(F.upper(F.trim(family)), F.lit(""))
    out = F.when(name.isin(*STOP_PARTY), name)
    for pattern, hint in FAMILY_HINTS:
        out = out.when(F.coalesce(reason, F.lit("")).rlike(f"(?i){pattern}"), hint)
    return out.otherwise(name)


def catalogue(spark: SparkSession) -> DataFrame:
    """(family, title, cause, standard): one row per known family."""
    return spark.createDataFrame([(f, *t) for f, t in ENGLISH.items()], "family string, title string, cause string, standard string")


def explained(faults: DataFrame, family: str = "family", reason: str = "reason", texts: DataFrame | None = None) -> DataFrame:
    """``faults`` with resolved_family, known_family, stop_party, title, cause and standard.

    ``texts`` is the catalogue, one row per family at most (eight rows here); Spark broadcasts it below its own limit.
    """
    resolved = resolve_family(F.col(family), F.col(reason))
    party = F.when(F.lit(False), "")
    for families, pattern, who in REASON_PARTY:
        party = party.when(F.col("resolved_family").isin(*families) & F.coalesce(F.col(reason), F.lit("")).rlike(f"(?i){pattern}"), who)
    for name, who in STOP_PARTY.items():
        party = party.when(F.col("resolved_family") == name, who)
    texts = (texts or catalogue(faults.sparkSession)).select(F.col("family").alias("resolved_family"), "title", "cause", "standard")
    out = faults.withColumn("resolved_family", resolved).withColumn("stop_party", party.otherwise("unknown"))
    out = out.join(texts, "resolved_family", "left").withColumn("known_family", F.col("title").isNotNull())
    return out.withColumns({c: F.coalesce(c, F.lit(t)) for c, t in zip(("title", "cause", "standard"), UNKNOWN)}).select(*faults.columns, "resolved_family", "known_family", "stop_party", "title", "cause", "standard")
