"""Fixed values of the charging standards and of the published rules, as data."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: seconds that an answer to each request may take, and that each response should take
MSG_TIMEOUT_S = {
    "supportedAppProtocolReq": 2.0, "SessionSetupReq": 2.0, "ServiceDiscoveryReq": 2.0, "ServiceDetailReq": 5.0,
    "ServicePaymentSelectionReq": 2.0, "PaymentDetailsReq": 5.0, "ContractAuthenticationReq": 2.0, "ChargeParameterDiscoveryReq": 2.0,
    "ChargingStatusReq": 2.0, "MeteringReceiptReq": 2.0, "PowerDeliveryReq": 5.0, "CableCheckReq": 2.0, "PreChargeReq": 2.0,
    "CurrentDemandReq": 0.25, "WeldingDetectionReq": 2.0, "SessionStopReq": 2.0, "CertificateInstallationReq": 5.0, "CertificateUpdateReq": 5.0,
}
RES_PERFORMANCE_S = {
    "supportedAppProtocolRes": 1.5, "SessionSetupRes": 1.5, "ServiceDiscoveryRes": 1.5, "ServiceDetailRes": 4.5,
    "ServicePaymentSelectionRes": 1.5, "PaymentDetailsRes": 4.5, "ContractAuthenticationRes": 1.5, "ChargeParameterDiscoveryRes": 1.5,
    "ChargingStatusRes": 1.5, "MeteringReceiptRes": 1.5, "PowerDeliveryRes": 4.5, "CableCheckRes": 1.5, "PreChargeRes": 1.5,
    "CurrentDemandRes": 0.025, "WeldingDetectionRes": 1.5, "SessionStopRes": 1.5, "CertificateInstallationRes": 4.5, "CertificateUpdateRes": 4.5,
}
SEQ_PERFORMANCE_S, SEQ_TIMEOUT_S = 40.0, 60.0
ONGOING_TIMEOUT_S, ONGOING_PERFORMANCE_S = 60.0, 55.0
COMM_SETUP_TIMEOUT_S, CABLECHECK_TIMEOUT_S, PRECHARGE_TIMEOUT_S = 20.0, 40.0, 7.0
MATCH_TIMEOUT_S, NORMATIVE_MATCH_S, MATCH_SESSION_S = 10.0, 0.6, 10.0

# fixed values: the requests that may follow each response ("" before the first)
NEXT_REQ = {
    "": ("supportedAppProtocolReq", "SessionSetupReq"),
    "supportedAppProtocolRes": ("SessionSetupReq",),
    "SessionSetupRes": ("ServiceDiscoveryReq",),
    "ServiceDiscoveryRes": ("ServiceDetailReq", "ServicePaymentSelectionReq"),
    "ServiceDetailRes": ("ServiceDetailReq", "ServicePaymentSelectionReq"),
    "ServicePaymentSelectionRes": ("ContractAuthenticationReq", "PaymentDetailsReq", "CertificateInstallationReq", "CertificateUpdateReq"),
    "CertificateInstallationRes": ("PaymentDetailsReq", "ContractAuthenticationReq"),
    "CertificateUpdateRes": ("PaymentDetailsReq", "ContractAuthenticationReq"),
    "PaymentDetailsRes": ("ContractAuthenticationReq",),
    "ContractAuthenticationRes": ("ContractAuthenticationReq", "ChargeParameterDiscoveryReq"),
    "ChargeParameterDiscoveryRes": ("ChargeParameterDiscoveryReq", "CableCheckReq"),
    "CableCheckRes": ("CableCheckReq", "PreChargeReq"),
    "PreChargeRes": ("PreChargeReq", "PowerDeliveryReq"),
    "PowerDeliveryRes": ("CurrentDemandReq", "WeldingDetectionReq", "SessionStopReq", "ChargeParameterDiscoveryReq"),
    "CurrentDemandRes": ("CurrentDemandReq", "MeteringReceiptReq", "PowerDeliveryReq"),
    "MeteringReceiptRes": ("CurrentDemandReq", "PowerDeliveryReq"),
    "WeldingDetectionRes": ("WeldingDetectionReq", "SessionStopReq"),
    "SessionStopRes": (),
}
# fixed values: stages in order
DC_STAGES = ("supportedAppProtocol", "SessionSetup", "ServiceDiscovery", "ServicePaymentSelection", "ContractAuthentication", "ChargeParameterDiscovery", "CableCheck", "PreCharge", "PowerDelivery", "CurrentDemand", "WeldingDetection", "SessionStop")
SLAC_STAGES = ("SLAC_PARM.REQ", "SLAC_PARM.CNF", "START_ATTEN_CHAR.IND", "MNBC_SOUND.IND", "ATTEN_PROFILE.IND", "ATTEN_CHAR.IND", "ATTEN_CHAR.RSP", "SLAC_MATCH.REQ", "SLAC_MATCH.CNF", "SET_KEY.REQ", "SET_KEY.CNF")
PHASES = ("idle", "slac", "handshake", "cablecheck", "precharge", "delivery", "closing")
PHASE_STEMS = {
    "handshake": ("supportedAppProtocol", "SessionSetup", "ServiceDiscovery", "ServicePaymentSelection", "ContractAuthentication", "ChargeParameterDiscovery"),
    "cablecheck": ("CableCheck",),
    "precharge": ("PreCharge",),
    "delivery": ("PowerDelivery", "CurrentDemand"),
    "closing": ("WeldingDetection", "SessionStop"),
}
# fixed values: severities
EVSE_SEVERITY = {"EVSE_NotReady": 0.1, "EVSE_Ready": 0.0, "EVSE_IsolationMonitoringActive": 0.0, "EVSE_Shutdown": 0.3, "EVSE_UtilityInterruptEvent": 0.6, "EVSE_EmergencyShutdown": 1.0, "EVSE_Malfunction": 1.0}
ISOLATION_SEVERITY = {"Invalid": 0.0, "No_IMD": 0.0, "Valid": 0.0, "Warning": 0.4, "Fault": 1.0}
NOTIFICATION_SEVERITY = {"None": 0.0, "StopCharging": 0.4, "ReNegotiation": 0.3}
FAMILIES = ("PROTOCOL_FAILED", "EVSE_FAULT", "ISOLATION_FAULT", "EV_ERROR", "SESSION_ABORT", "SLAC_FAILURE", "COMM_FREEZE", "NO_POWER_DELIVERED", "EVSE_PROCESSING_STALL", "PRECHARGE_FAULT")
OPENERS = ("supportedAppProtocolReq", "SessionSetupReq")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def lookup(values: dict, key: Column, default=None) -> Column:
    """``values[key]``; ``default`` for null and unknown keys."""
    found = F.element_at(literal_map(values), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def message_limits(spark: SparkSession) -> DataFrame:
    """One row per message: name, direction, limit in seconds."""
    rows = [(m, "request", s) for m, s in MSG_TIMEOUT_S.items()] + [(m, "response", s) for m, s in RES_PERFORMANCE_S.items()]
    return spark.createDataFrame(rows, "msg string, direction string, limit_s double")


def successors(spark: SparkSession) -> DataFrame:
    """One row per legal (response, next request)."""
    return spark.createDataFrame([(r, q) for r, qs in NEXT_REQ.items() for q in qs], "response string, request string")
