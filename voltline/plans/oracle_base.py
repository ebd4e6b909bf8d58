"""The telemetry mapping and the sessionizer in DuckDB's SQL: the first CTEs of the oracles."""

TEL = """
ev0 AS (
  SELECT event_id AS seq, epoch_us(ts) / (1e6 * 720.0) AS t, user_id AS u, event_type AS e, value AS v,
         CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
ev1 AS (
  SELECT *, 'ST' || lpad(CAST(u // 2 AS VARCHAR), 4, '0') AS station, 'connector' || CAST(u % 2 + 1 AS VARCHAR) AS connector,
    CASE e
      WHEN 'signup' THEN CASE WHEN k < 60 THEN 'supportedAppProtocolReq' ELSE 'SessionSetupReq' END
      WHEN 'click' THEN CASE WHEN k < 40 THEN 'CurrentDemandReq' WHEN k < 50 THEN 'CableCheckReq' WHEN k < 60 THEN 'PreChargeReq'
        WHEN k < 70 THEN 'ChargeParameterDiscoveryReq' WHEN k < 80 THEN 'PowerDeliveryReq' WHEN k < 90 THEN 'ServiceDiscoveryReq' ELSE 'WeldingDetectionReq' END
      WHEN 'view' THEN CASE WHEN k < 25 THEN 'CurrentDemandRes' WHEN k < 35 THEN 'CableCheckRes' WHEN k < 40 THEN 'SessionSetupRes' WHEN k < 45 THEN 'PreChargeRes'
        WHEN k < 50 THEN 'ChargeParameterDiscoveryRes' WHEN k < 70 THEN 'CM_LINK_STATUS.CNF' WHEN k < 78 THEN 'CM_SLAC_PARM.REQ' WHEN k < 82 THEN 'CM_SLAC_PARM.CNF'
        WHEN k < 86 THEN 'CM_SLAC_MATCH.REQ' WHEN k < 90 THEN 'CM_SLAC_MATCH.CNF' WHEN k < 94 THEN 'CM_ATTEN_CHAR.RSP' WHEN k < 96 THEN 'CM_VALIDATE.REQ' ELSE 'RETX' END
      WHEN 'purchase' THEN CASE WHEN k < 70 THEN 'SessionStopRes' ELSE 'SessionStopReq' END
      WHEN 'error' THEN CASE WHEN k < 20 THEN 'PowerDeliveryRes' WHEN k < 40 THEN 'CurrentDemandRes' WHEN k < 60 THEN 'CurrentDemandReq' WHEN k < 80 THEN 'CableCheckRes' ELSE 'RST' END
    END AS msg FROM ev0),
tel AS (
  SELECT seq, t, station, connector, msg,
    CASE WHEN msg LIKE 'CM\\_%' ESCAPE '\\' THEN 'hpav' WHEN msg IN ('RST', 'RETX') THEN 'tcp' ELSE 'v2g' END AS kind,
    CASE WHEN e = 'error' AND k < 20 THEN 'FAILED_SequenceError' ELSE '' END AS resp_code,
    CASE WHEN e = 'error' AND k BETWEEN 20 AND 39 THEN 'EVSE_Malfunction' ELSE '' END AS evse_status,
    CASE WHEN e = 'error' AND k BETWEEN 60 AND 79 THEN 'Fault' WHEN msg = 'CableCheckRes' AND k % 3 = 0 THEN 'Warning' ELSE '' END AS isolation,
    CASE WHEN msg LIKE '%Res' AND k % 11 = 0 THEN 'StopCharging' ELSE '' END AS notification,
    CASE WHEN e = 'error' AND k BETWEEN 40 AND 59 THEN 'FAILED_ChargerConnectorLockFault' ELSE '' END AS ev_err,
    CASE WHEN msg = 'CurrentDemandReq' AND k % 7 = 0 THEN 'true' ELSE '' END AS charge_complete,
    CASE WHEN msg = 'CableCheckRes' THEN CASE WHEN k % 2 = 0 THEN 'Ongoing' ELSE 'Finished' END WHEN msg = 'ChargeParameterDiscoveryRes' THEN 'Ongoing' ELSE '' END AS evse_processing,
    CASE WHEN msg = 'CurrentDemandRes' AND k % 3 = 0 THEN 'c' ELSE '' END AS limit_achieved,
    CASE WHEN msg LIKE '%Res' AND k % 13 = 0 THEN 'FAIL' ELSE '' END AS validation,
    CASE WHEN msg LIKE 'CM\\_%' ESCAPE '\\' THEN '' ELSE CAST(k % 2 AS VARCHAR) END AS tcp_stream,
    CASE WHEN msg = 'CurrentDemandRes' THEN CAST(k AS DOUBLE) END AS soc,
    CASE WHEN msg IN ('CurrentDemandRes', 'PreChargeRes') THEN v END AS evse_v,
    CASE WHEN msg = 'CurrentDemandRes' THEN v / 4 END AS evse_i,
    CASE WHEN msg IN ('CurrentDemandReq', 'PreChargeReq') THEN k + 40.0::DOUBLE END AS ev_target_v,
    CASE WHEN msg = 'CurrentDemandReq' THEN k * 2.0::DOUBLE END AS ev_target_i,
    CASE WHEN msg = 'ChargeParameterDiscoveryReq' THEN k + 200.0::DOUBLE END AS ev_max_v,
    CASE WHEN msg = 'ChargeParameterDiscoveryRes' THEN k + 100.0::DOUBLE END AS evse_max_v,
    CASE WHEN msg = 'ChargeParameterDiscoveryRes' THEN k + 50.0::DOUBLE END AS evse_max_i,
    CASE WHEN msg = 'CurrentDemandRes' THEN v / 10 END AS remaining_full_min,
    k, e AS source
  FROM ev1)"""

SES = (
    TEL
    + """,
s0 AS (
  SELECT *, kind IN ('v2g', 'sdp', 'tcp') OR (kind = 'hpav' AND regexp_matches(msg, 'SLAC|ATTEN_CHAR|SET_KEY|VALIDATE')) AS act FROM tel),
s1 AS (
  SELECT *, last_value(CASE WHEN act THEN t END IGNORE NULLS) OVER (PARTITION BY station, connector ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM s0),
s2 AS (
  SELECT *, sum(CASE WHEN act AND (la IS NULL OR t - la > 60) THEN 1 ELSE 0 END) OVER (PARTITION BY station, connector ORDER BY t, seq) AS run,
    CASE WHEN msg IN ('SessionStopReq', 'SessionStopRes') THEN 'S' WHEN msg IN ('supportedAppProtocolReq', 'SessionSetupReq') THEN 'O' END AS mk FROM s1),
s3 AS (
  SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY station, connector, run ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s2),
s4 AS (
  SELECT *, sum(CASE WHEN act AND (la IS NULL OR t - la > 60) OR (mk = 'O' AND pm = 'S') THEN 1 ELSE 0 END) OVER (PARTITION BY station, connector ORDER BY t, seq) - 1 AS sid0,
    first_value(CASE WHEN act THEN t END IGNORE NULLS) OVER (PARTITION BY station, connector ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na,
    coalesce(act OR t - la <= 60, false) AS stays FROM s3),
s5 AS (
  SELECT *, row_number() OVER (PARTITION BY station, connector, stays, sid0 ORDER BY t DESC, seq DESC) AS back, count(*) OVER (PARTITION BY station, connector, stays, sid0) AS nb FROM s4),
s6 AS (
  SELECT * EXCLUDE (sid0, la, na, stays, back, nb, run, mk, pm, act),
    CAST(CASE WHEN stays THEN sid0 WHEN back <= CASE WHEN nb <= 200 THEN nb ELSE 100 + (nb - 201) % 101 END AND na - t <= 10 THEN sid0 + 1 END AS INT) AS sid
  FROM s5),
ses AS (SELECT * FROM s6 WHERE sid IS NOT NULL)"""
)

P = "PARTITION BY station, connector, sid"
O = "ORDER BY t, seq"
B = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def last(expr: str, keys: str = "", before: bool = False) -> str:
    return f"last_value({expr} IGNORE NULLS) OVER ({P}{keys} {O} {B if before else 'ROWS UNBOUNDED PRECEDING'})"


def run(agg: str, keys: str = "") -> str:
    return f"{agg} OVER ({P}{keys} {O} ROWS UNBOUNDED PRECEDING)"


PHASE = """CASE WHEN kind = 'hpav' AND contains(msg, 'SLAC_PARM.REQ') THEN 'slac'
  WHEN kind = 'v2g' AND regexp_matches(msg, '^(supportedAppProtocol|SessionSetup|ServiceDiscovery|ServicePaymentSelection|ContractAuthentication|ChargeParameterDiscovery)(Req|Res)$') THEN 'handshake'
  WHEN kind = 'v2g' AND regexp_matches(msg, '^CableCheck') THEN 'cablecheck' WHEN kind = 'v2g' AND regexp_matches(msg, '^PreCharge') THEN 'precharge'
  WHEN kind = 'v2g' AND regexp_matches(msg, '^(PowerDelivery|CurrentDemand)') THEN 'delivery' WHEN kind = 'v2g' AND regexp_matches(msg, '^(WeldingDetection|SessionStop)') THEN 'closing' END"""

PH = SES + f""",
p0 AS (SELECT *, coalesce({last(PHASE)}, 'idle') AS phase FROM ses),
p1 AS (SELECT *, lag(phase) OVER ({P} {O}) AS pp FROM p0),
p2 AS (SELECT *, {run("sum(CASE WHEN phase <> coalesce(pp, 'idle') THEN 1 ELSE 0 END)")} AS turn FROM p1),
ph AS (SELECT *, t - {run("min(t)", ", turn")} AS phase_elapsed, t - {run("min(t)")} AS session_elapsed FROM p2)"""

TRACK = PH + f""",
k0 AS (SELECT *,
  CASE WHEN kind = 'v2g' THEN t - {last("CASE WHEN kind = 'v2g' THEN t END", before=True)} END AS dt_v2g,
  CASE WHEN kind = 'v2g' AND right(msg, 3) IN ('Req', 'Res') THEN left(msg, len(msg) - 3) ELSE '' END AS base,
  CASE WHEN kind = 'v2g' THEN right(msg, 3) ELSE '' END AS sfx,
  {run("max(CASE WHEN msg = 'RST' THEN 1 ELSE 0 END)")} = 1 AS rst_seen,
  t - {last("CASE WHEN msg LIKE '%LINK_STATUS%CNF' THEN t END")} AS link_gap,
  {run("sum(CASE WHEN contains(msg, 'SLAC_PARM.REQ') THEN 1 ELSE 0 END)")} AS slac_attempts,
  (SELECT count(*) FROM ses r WHERE r.station = ph.station AND r.connector = ph.connector AND r.sid = ph.sid AND r.kind = 'tcp' AND r.msg <> 'RST' AND r.t >= ph.t - 60 AND (r.t < ph.t OR (r.t = ph.t AND r.seq <= ph.seq))) AS retx_60s,
  {run("sum(CASE WHEN msg = 'CableCheckReq' THEN 1 ELSE 0 END)")} AS cablecheck_n,
  CASE WHEN phase = 'cablecheck' THEN coalesce(t - {run("min(CASE WHEN msg = 'CableCheckReq' THEN t END)")}, 0) ELSE 0 END AS cablecheck_elapsed,
  CASE WHEN phase = 'precharge' THEN coalesce(t - {run("min(CASE WHEN msg = 'PreChargeReq' THEN t END)")}, 0) ELSE 0 END AS precharge_elapsed,
  coalesce(ev_target_v, {last("ev_target_v")}) AS tv, coalesce(ev_target_i, {last("ev_target_i")}) AS ti, coalesce(ev_max_v, {last("ev_max_v")}) AS mv
  FROM ph),
k1 AS (SELECT *, {last("CASE sfx WHEN 'Req' THEN t WHEN 'Res' THEN -1 END", ", base", True)} AS sent,
  {run("max(CASE WHEN evse_i >= 0.8 * ti AND ti > 20 THEN 1 ELSE 0 END)")} = 1 AS reached FROM k0),
k2 AS (SELECT *, CASE WHEN sfx = 'Res' AND sent >= 0 THEN t - sent END AS req_res_latency,
  CASE WHEN tv <> 0 THEN evse_v - tv END AS v_dev, CASE WHEN ti <> 0 THEN evse_i - ti END AS i_dev,
  CASE WHEN phase = 'precharge' AND tv <> 0 THEN tv - evse_v END AS precharge_v_gap,
  coalesce(mv <> 0 AND evse_v > mv * 1.02::DOUBLE, false) AS v_over,
  coalesce(phase = 'delivery' AND ti > 50 AND evse_i < greatest(0.15::DOUBLE * ti, 5) AND reached AND NOT contains(limit_achieved, 'c'), false) AS i_collapse FROM k1),
trk AS (SELECT *, {run("sum(CASE WHEN evse_i IS NOT NULL AND NOT i_collapse THEN 1 ELSE 0 END)")} AS island FROM k2)"""

_REQS = {"supportedAppProtocol": 2.0, "SessionSetup": 2.0, "ServiceDiscovery": 2.0, "ServiceDetail": 5.0, "ServicePaymentSelection": 2.0, "PaymentDetails": 5.0, "ContractAuthentication": 2.0, "ChargeParameterDiscovery": 2.0, "ChargingStatus": 2.0, "MeteringReceipt": 2.0, "PowerDelivery": 5.0, "CableCheck": 2.0, "PreCharge": 2.0, "CurrentDemand": 0.25, "WeldingDetection": 2.0, "SessionStop": 2.0}
_USED = ("supportedAppProtocol", "SessionSetup", "ServiceDiscovery", "ChargeParameterDiscovery", "PowerDelivery", "CableCheck", "PreCharge", "CurrentDemand", "WeldingDetection", "SessionStop")
LIMIT = "CASE {} " + " ".join(f"WHEN '{b}' THEN {v}::DOUBLE" for b, v in _REQS.items()) + " END"
PERF = "CASE {} " + " ".join(f"WHEN '{b}' THEN {({2.0: 1.5, 5.0: 4.5, 0.25: 0.025})[v]}::DOUBLE" for b, v in _REQS.items()) + " END"
# per message the request that waits, then the worst of them and how many pass their limit at this row
_WAITS = ", ".join(f"""{last(f"CASE msg WHEN '{b}Req' THEN t WHEN '{b}Res' THEN -1 END", ", dialog")} AS w{i}""" for i, b in enumerate(_USED))
_OUT = ", ".join(f"CASE WHEN w{i} >= 0 THEN (t - w{i}) / {_REQS[b]}::DOUBLE ELSE 0 END" for i, b in enumerate(_USED))
_PAST = " + ".join(f"CASE WHEN w{i} >= 0 AND t - w{i} >= {_REQS[b]}::DOUBLE AND pt - w{i} < {_REQS[b]}::DOUBLE THEN 1 ELSE 0 END" for i, b in enumerate(_USED))
D = ", dialog"
_NEXT = {
    "": "supportedAppProtocolReq SessionSetupReq", "supportedAppProtocolRes": "SessionSetupReq", "SessionSetupRes": "ServiceDiscoveryReq", "ServiceDiscoveryRes": "ServiceDetailReq ServicePaymentSelectionReq",
    "ChargeParameterDiscoveryRes": "ChargeParameterDiscoveryReq CableCheckReq", "CableCheckRes": "CableCheckReq PreChargeReq", "PreChargeRes": "PreChargeReq PowerDeliveryReq",
    "PowerDeliveryRes": "CurrentDemandReq WeldingDetectionReq SessionStopReq ChargeParameterDiscoveryReq", "CurrentDemandRes": "CurrentDemandReq MeteringReceiptReq PowerDeliveryReq",
    "WeldingDetectionRes": "WeldingDetectionReq SessionStopReq", "SessionStopRes": "",
}
_LEGAL = "CASE coalesce(lres, '') " + " ".join(f"WHEN '{r}' THEN [{', '.join(repr(q) for q in qs.split())}]::VARCHAR[]" for r, qs in _NEXT.items()) + " END"
_STAGES = "supportedAppProtocol SessionSetup ServiceDiscovery ServicePaymentSelection ContractAuthentication ChargeParameterDiscovery CableCheck PreCharge PowerDelivery CurrentDemand WeldingDetection SessionStop".split()
STAGE = "CASE WHEN kind = 'v2g' THEN CASE regexp_replace(msg, '(Req|Res)$', '') " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_STAGES)) + " END END"

CONF = TRACK + f""",
c0 AS (SELECT *, {last("CASE WHEN sfx = 'Res' OR msg = 'supportedAppProtocolReq' THEN msg END", before=True)} AS mk FROM trk),
c1 AS (SELECT *, CAST({run("sum(CASE WHEN msg = 'supportedAppProtocolReq' OR (msg = 'SessionSetupReq' AND coalesce(mk, '') <> 'supportedAppProtocolRes') THEN 1 ELSE 0 END)")} AS BIGINT) AS dialog FROM c0),
c1w AS (SELECT *, {_WAITS}, lag(t) OVER ({P}, dialog {O}) AS pt FROM c1),
c2 AS (SELECT *,
  {last("CASE sfx WHEN 'Req' THEN t WHEN 'Res' THEN -1 END", ", dialog, base", True)} AS dsent,
  greatest({_OUT}) AS waiting, {_PAST} AS past, {last("ev_target_v")} AS target,
  {last("CASE WHEN sfx = 'Req' THEN -1 WHEN sfx = 'Res' AND (msg = 'SessionStopRes' OR resp_code <> '') THEN -1 WHEN sfx = 'Res' THEN t END", D, True)} AS sqb,
  {last("CASE WHEN sfx = 'Req' THEN -1 WHEN sfx = 'Res' AND (msg = 'SessionStopRes' OR resp_code <> '') THEN -1 WHEN sfx = 'Res' THEN t END", D)} AS sq,
  {run("sum(CASE WHEN evse_processing = 'Finished' OR (sfx = 'Res' AND (msg = 'SessionStopRes' OR resp_code <> '')) THEN 1 ELSE 0 END)", D)} AS og,
  greatest({last("CASE WHEN contains(msg, 'SLAC_MATCH.CNF') THEN t END")}, {run("min(t)", D)}) AS ready,
  {run("min(CASE WHEN msg = 'SessionSetupRes' THEN t END)", D)} AS setup,
  {run("min(CASE WHEN msg = 'CableCheckReq' THEN t END)", D)} AS cc0,
  {run("min(CASE WHEN msg = 'PreChargeReq' THEN t END)", D)} AS pc0,
  {run("max(CASE WHEN msg = 'PowerDeliveryReq' THEN 1 ELSE 0 END)", D)} AS pd,
  {last("CASE WHEN sfx = 'Res' THEN msg END", D, True)} AS lres,
  coalesce({run(f"max({STAGE})")}, -1) AS stage_max
  FROM c1w),
c3 AS (SELECT *, CASE WHEN sfx = 'Res' AND dsent >= 0 THEN t - dsent END AS dlat,
  CASE WHEN sq >= 0 THEN t - sq ELSE 0 END AS seq_gap_s,
  coalesce(t - {run("min(CASE WHEN evse_processing = 'Ongoing' THEN t END)", ", dialog, og")}, 0) AS ongoing_s,
  CASE WHEN dialog = 0 THEN 0 ELSE coalesce(setup, t) - ready END AS comm_setup_s,
  {run("min(CASE WHEN (msg = 'CableCheckRes' AND resp_code = '' AND evse_processing = 'Finished') OR (msg = 'PreChargeReq' AND cc0 IS NOT NULL) THEN t END)", D)} AS cc1,
  CASE WHEN pd = 1 THEN 0 ELSE coalesce(t - pc0, 0) END AS precharge_s,
  coalesce(sfx = 'Req' AND dialog > 0 AND NOT list_contains({_LEGAL}, msg), false) AS seq_illegal
  FROM c2),
conf0 AS (SELECT *, greatest(coalesce(dlat / {LIMIT.format('base')}, 0), waiting) AS msg_timeout_ratio,
  past + CASE WHEN dlat >= {LIMIT.format('base')} AND pt - dsent < {LIMIT.format('base')} THEN 1 ELSE 0 END AS breach,
  CAST({run("sum(CASE WHEN sfx = 'Req' AND sqb >= 0 AND t - sqb >= 40 THEN 1 ELSE 0 END)")} AS BIGINT) AS n_seq_breach,
  CASE WHEN precharge_s / 7 >= 0.5 AND evse_v IS NOT NULL AND target <> 0 THEN abs(target - evse_v) / greatest(20, 0.05::DOUBLE * target) ELSE 0 END AS precharge_v_gap_ratio,
  coalesce(dlat / {PERF.format('base')}, 0) AS msg_perf_ratio,
  coalesce(coalesce(cc1, t) - cc0, 0) AS cablecheck_s, cc0 IS NOT NULL AND cc1 IS NULL AS cablecheck_open,
  CAST({run("sum(CASE WHEN seq_illegal THEN 1 ELSE 0 END)")} AS BIGINT) AS n_seq_illegal,
  coalesce({STAGE} < stage_max AND seq_illegal, false) AS stage_regress,
  coalesce(evse_v / nullif({last("evse_max_v")}, 0) - 1, 0) AS v_over_max, coalesce(evse_i / nullif({last("evse_max_i")}, 0) - 1, 0) AS i_over_max
  FROM c3),
conf AS (SELECT *, {run("max(msg_timeout_ratio)")} AS msg_timeout_max, CAST({run("sum(breach)")} AS BIGINT) AS n_msg_breach FROM conf0)"""

_SLAC = "SLAC_PARM.REQ SLAC_PARM.CNF START_ATTEN_CHAR.IND MNBC_SOUND.IND ATTEN_PROFILE.IND ATTEN_CHAR.IND ATTEN_CHAR.RSP SLAC_MATCH.REQ SLAC_MATCH.CNF SET_KEY.REQ SET_KEY.CNF".split()
MATCH = SES + f""",
m0 AS (SELECT *, CASE {' '.join(f"WHEN contains(msg, '{x}') THEN {i + 1}" for i, x in enumerate(_SLAC))} END AS st FROM ses),
m1 AS (SELECT *, {run("sum(CASE WHEN st = 9 THEN 1 ELSE 0 END)")} AS cnf, {run("sum(CASE WHEN st = 8 OR contains(msg, 'VALIDATE.REQ') THEN 1 ELSE 0 END)")} AS asked,
  {last("CASE WHEN st = 1 THEN 1 WHEN st > 2 THEN 2 END", before=True)} AS late FROM m0),
m2 AS (SELECT *, {run("min(CASE WHEN st = 8 THEN t END)", ", cnf")} AS pend, {run("min(CASE WHEN contains(msg, 'ATTEN_CHAR.RSP') THEN t END)", ", asked")} AS await_t FROM m1),
mat AS (SELECT *, coalesce({run("max(st)")}, 0) AS slac_stage, cnf > 0 AS matched, {run("max(CASE WHEN kind = 'v2g' THEN 1 ELSE 0 END)")} = 1 AS v2g_seen,
  pend IS NOT NULL AS match_pending, coalesce(t - pend, 0) AS match_pending_s, await_t IS NOT NULL AS awaiting, coalesce(t - await_t, 0) AS awaiting_s,
  CAST({run("sum(CASE WHEN st = 8 THEN 1 ELSE 0 END)")} AS BIGINT) AS n_match_req, CAST({run("sum(CASE WHEN st = 1 AND late = 2 THEN 1 ELSE 0 END)")} AS BIGINT) AS n_restart,
  coalesce(t - {last("CASE WHEN st = 9 THEN t END")}, 0) AS since_match_s FROM m2)"""

FACTS = """facts AS (SELECT station, connector, sid, min(t) AS t_start, max(t) AS t_end, count(*) AS n_events, count(*) FILTER (kind = 'v2g') AS n_v2g,
  count(*) FILTER (regexp_matches(msg, 'SLAC|ATTEN_CHAR')) AS n_slac, min(t) FILTER (regexp_matches(msg, 'SLAC|ATTEN_CHAR')) AS first_slac, min(t) FILTER (kind = 'v2g') AS first_v2g,
  min(t) FILTER (msg LIKE 'CurrentDemand%') AS first_cd, max(t) FILTER (msg LIKE 'CurrentDemand%') AS last_cd,
  max(t) FILTER (msg = 'SessionStopRes' AND resp_code = '') AS stop_res, min(t) FILTER (msg = 'SessionStopReq') AS stop_req,
  max(t) FILTER (msg IN ('supportedAppProtocolReq', 'SessionSetupReq')) AS last_opener, min(t) FILTER (msg = 'ChargeParameterDiscoveryReq') AS param_req,
  min(t) FILTER (msg = 'CableCheckReq') AS cable_req, max(t) FILTER (regexp_matches(msg, '^(ChargeParameterDiscovery|CableCheck|PreCharge|PowerDelivery)')) AS last_dc,
  max(t) FILTER (msg LIKE 'CableCheck%') AS last_cable, coalesce(bool_or(msg LIKE 'PreCharge%'), false) AS has_precharge, coalesce(bool_or(msg LIKE 'PowerDelivery%'), false) AS has_power
  FROM ses GROUP BY ALL),
fct AS (SELECT *, coalesce(stop_res IS NOT NULL AND (last_opener IS NULL OR stop_res >= last_opener), false) AS graceful_close, first_cd IS NOT NULL AS reached_current_demand FROM facts WHERE n_v2g > 0 OR n_slac >= 3)"""

K3 = "station, connector, sid"
MARK = f"""mark AS (SELECT {K3}, t, 'PROTOCOL_FAILED' AS family FROM ses WHERE resp_code <> '' UNION ALL SELECT {K3}, t, 'EVSE_FAULT' FROM ses WHERE evse_status <> ''
  UNION ALL SELECT {K3}, t, 'ISOLATION_FAULT' FROM ses WHERE isolation = 'Fault' UNION ALL SELECT {K3}, t, 'EV_ERROR' FROM ses WHERE ev_err <> '')"""
STUCK = f"""stuck AS (SELECT {K3}, cable_req + 60 AS t, 'COMM_FREEZE' AS family FROM fct f WHERE cable_req IS NOT NULL AND
  coalesce((SELECT min(t) FROM ses s WHERE s.station = f.station AND s.connector = f.connector AND s.sid = f.sid AND s.t > f.cable_req AND s.msg IN ('PreChargeReq', 'PowerDeliveryReq')), last_cable) - cable_req > 60)"""
STALL = f"""stall AS (SELECT {K3}, lt + 5 AS t, 'COMM_FREEZE' AS family FROM (SELECT {K3}, t, lag(t) OVER (PARTITION BY {K3} ORDER BY t, seq) AS lt FROM ses JOIN fct USING ({K3}) WHERE kind = 'v2g' AND t BETWEEN first_cd AND last_cd) WHERE t - lt > 5)"""
SLACF = f"""slacf AS (SELECT {K3}, t_end AS t, 'SLAC_FAILURE' AS family FROM fct WHERE n_v2g = 0), slow AS (SELECT {K3}, first_slac + 60 AS t, 'SLAC_FAILURE' AS family FROM fct WHERE first_v2g - first_slac > 60)"""
SAME = "o.station = s.station AND o.connector = s.connector AND o.sid = s.sid"
REMATCH = f"""rm0 AS (SELECT s.*, first_v2g, graceful_close, stop_res,
    (SELECT min(o.t) FROM ses o WHERE {SAME} AND o.kind = 'v2g' AND o.t > s.t) AS nxt, coalesce((SELECT max(o.t) FROM ses o WHERE {SAME} AND o.kind = 'v2g' AND o.t < s.t), first_v2g) AS prv,
    EXISTS (SELECT 1 FROM ses o WHERE {SAME} AND contains(o.msg, 'SLAC_PARM.CNF') AND o.t BETWEEN s.t AND s.t + 10) AS answered,
    EXISTS (SELECT 1 FROM ses o WHERE {SAME} AND o.msg = 'supportedAppProtocolReq' AND o.t > s.t) AS again
  FROM ses s JOIN fct USING ({K3}) WHERE contains(s.msg, 'SLAC_PARM.REQ') AND n_v2g > 0 AND s.t > first_v2g + 1 AND NOT (graceful_close AND s.t > stop_res)),
remat AS (SELECT {K3}, arg_min(prv, (t, seq)) AS t, 'SESSION_ABORT' AS family FROM rm0 WHERE nxt IS NULL OR nxt - prv > 5 OR answered OR again GROUP BY ALL)"""
RESET = f"""rest AS (SELECT * FROM fct WHERE n_v2g > 0 AND NOT graceful_close AND ({K3}) NOT IN (SELECT ({K3}) FROM remat)),
streams AS (SELECT {K3}, list(DISTINCT tcp_stream) AS st FROM ses WHERE kind = 'v2g' AND tcp_stream <> '' GROUP BY ALL),
reset AS (SELECT {K3}, min(t) AS t, 'SESSION_ABORT' AS family FROM ses JOIN rest USING ({K3}) LEFT JOIN streams USING ({K3}) WHERE msg = 'RST' AND t >= first_v2g AND (st IS NULL OR list_contains(st, tcp_stream)) GROUP BY ALL)"""
NOPOWER = f"""nopower AS (SELECT {K3}, coalesce(stop_req, last_dc, stop_res) AS t, 'NO_POWER_DELIVERED' AS family FROM fct WHERE graceful_close AND first_cd IS NULL AND param_req IS NOT NULL)"""
W = "PARTITION BY station, connector, sid ORDER BY t, seq"
EVID = f"""ev_q AS (SELECT * FROM rest WHERE ({K3}) NOT IN (SELECT ({K3}) FROM reset)),
ev_a AS (SELECT s.*, q.t_end, right(msg, 3) AS sx, left(msg, len(msg) - 3) AS bs FROM ses s JOIN ev_q q USING ({K3}) WHERE kind = 'v2g'),
ev_b AS (SELECT *, last_value(CASE WHEN sx = 'Res' THEN msg END IGNORE NULLS) OVER ({W} {B}) AS lr, last_value(CASE sx WHEN 'Req' THEN -1 WHEN 'Res' THEN t END IGNORE NULLS) OVER ({W} {B}) AS since,
  lag(bs) OVER ({W}) AS pb FROM ev_a),
ev_c AS (SELECT *, sum(CASE WHEN msg = 'supportedAppProtocolReq' OR (msg = 'SessionSetupReq' AND coalesce(lr, '') <> 'supportedAppProtocolRes') THEN 1 ELSE 0 END) OVER ({W}) AS nd,
  msg = 'supportedAppProtocolReq' OR (msg = 'SessionSetupReq' AND coalesce(lr, '') <> 'supportedAppProtocolRes') AS op,
  sum(CASE WHEN bs <> coalesce(pb, bs) OR (evse_processing = 'Finished' AND sx = 'Res') THEN 1 ELSE 0 END) OVER ({W}) AS g FROM ev_b),
ev_d AS (SELECT *, min(CASE WHEN sx = 'Res' AND evse_processing = 'Ongoing' THEN t END) OVER (PARTITION BY station, connector, sid, g ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS og FROM ev_c),
ev_w AS (
  SELECT {K3}, lt + lim AS at FROM (SELECT {K3}, bs, t_end, arg_max(sx, (t, seq)) AS ls, arg_max(t, (t, seq)) AS lt FROM ev_a GROUP BY ALL), (SELECT * FROM (VALUES {', '.join(f"('{b}', {v}::DOUBLE)" for b, v in _REQS.items())}) x(lb, lim)) WHERE lb = bs AND ls = 'Req' AND t_end - lt >= lim
  UNION ALL SELECT {K3}, lt + 60 FROM (SELECT {K3}, t_end, arg_max(sx, (t, seq)) AS ls, arg_max(t, (t, seq)) AS lt FROM ev_a GROUP BY ALL) WHERE ls = 'Res' AND t_end - lt >= 60
  UNION ALL SELECT {K3}, og + 60 FROM (SELECT *, row_number() OVER (PARTITION BY station, connector, sid ORDER BY t DESC, seq DESC) AS rn FROM ev_d) WHERE rn = 1 AND t_end - og >= 60),
evid AS (SELECT {K3}, min(t) AS t, 'SESSION_ABORT' AS family FROM (
  SELECT {K3}, t FROM ev_d WHERE op AND nd > 1
  UNION ALL SELECT {K3}, since + 60 FROM ev_d WHERE sx = 'Req' AND since >= 0 AND t - since >= 60
  UNION ALL SELECT {K3}, og + 60 FROM ev_d WHERE sx = 'Res' AND evse_processing = 'Ongoing' AND t - og >= 60
  UNION ALL SELECT s.station, s.connector, s.sid, s.at FROM ev_w s WHERE (SELECT count(*) FROM ses o WHERE {SAME} AND o.t > s.at AND o.t <= s.at + 10) >= 20) GROUP BY ALL)"""
REAL = f"SELECT m.* FROM mark m SEMI JOIN fct USING ({K3})"
LABELS = f"""{FACTS}, {MARK}, {STUCK}, {STALL}, {SLACF}, {REMATCH}, {RESET}, {NOPOWER}, {EVID},
cand AS ({REAL} UNION ALL FROM stuck UNION ALL FROM stall UNION ALL FROM slacf UNION ALL FROM slow UNION ALL FROM remat UNION ALL FROM reset UNION ALL FROM nopower UNION ALL FROM evid),
ff AS (SELECT {K3}, family, min(t) AS t FROM cand GROUP BY ALL),
lab AS (SELECT f.*, a.first_fault_t, a.first_fault_family, coalesce(a.families, []) AS families, coalesce(a.n, 0) AS n_faults
  FROM fct f LEFT JOIN (SELECT {K3}, min(t) AS first_fault_t, arg_min(family, (t, family)) AS first_fault_family, list_sort(list(family)) AS families, count(*) AS n FROM ff GROUP BY ALL) a USING ({K3}))"""

SPEC = """CASE WHEN resp_code <> '' THEN 'PROTOCOL_FAILED' WHEN evse_status <> '' THEN 'EVSE_FAULT' WHEN isolation = 'Fault' THEN 'ISOLATION_FAULT' WHEN ev_err <> '' THEN 'EV_ERROR'
  WHEN cablecheck_elapsed > 40 THEN 'COMM_FREEZE' WHEN phase = 'delivery' AND dt_v2g > 3.5 THEN 'COMM_FREEZE' WHEN v_over THEN 'EVSE_FAULT' WHEN retx_60s > 60 THEN 'SESSION_ABORT'
  WHEN link_gap > 3 AND phase <> 'idle' THEN 'SESSION_ABORT' WHEN slac_attempts >= 3 THEN 'SLAC_FAILURE' WHEN rst_seen AND phase IN ('delivery', 'cablecheck', 'precharge') THEN 'SESSION_ABORT' END"""
CONFR = """CASE WHEN resp_code <> '' THEN 'PROTOCOL_FAILED' WHEN evse_status <> '' THEN 'EVSE_FAULT' WHEN isolation = 'Fault' THEN 'ISOLATION_FAULT' WHEN ev_err <> '' THEN 'EV_ERROR'
  WHEN ongoing_s >= 55 THEN 'COMM_FREEZE' WHEN seq_gap_s >= 60 THEN 'COMM_FREEZE' WHEN comm_setup_s >= 20 THEN 'SESSION_ABORT' WHEN cablecheck_open AND cablecheck_s >= 40 THEN 'COMM_FREEZE'
  WHEN dialog > 1 THEN 'SESSION_ABORT' WHEN msg_timeout_ratio >= 1 THEN 'COMM_FREEZE' END"""


def alerts(source: str, rule: str, name: str) -> str:
    return f"SELECT {K3}, '{name}' AS detector, arg_min(t, (t, seq)) AS t, arg_min(g, (t, seq)) AS guess FROM (SELECT *, {rule} AS g FROM {source}) WHERE g IS NOT NULL GROUP BY ALL"


SCORED = CONF + f""", {LABELS},
al AS ({alerts("trk", SPEC, "Spec")} UNION ALL {alerts("conf", CONFR, "Conformance")}),
sc AS (SELECT l.*, d.detector, al.t AS alert_t, al.guess,
  CASE WHEN n_faults > 0 THEN CASE WHEN al.t IS NULL THEN 'miss' WHEN al.t <= first_fault_t + 10 THEN 'tp' ELSE 'late' END ELSE CASE WHEN al.t IS NULL THEN 'quiet' ELSE 'fp' END END AS outcome,
  CASE WHEN n_faults > 0 AND al.t <= first_fault_t + 10 THEN greatest(0, first_fault_t - al.t) END AS lead
  FROM lab l CROSS JOIN (VALUES ('Spec'), ('Conformance')) d(detector) LEFT JOIN al ON al.station = l.station AND al.connector = l.connector AND al.sid = l.sid AND al.detector = d.detector)"""


def ewm(name: str, source: str, alpha: float = 0.05) -> str:
    """CTEs {name}0 to {name}: mean, variance and z of column x of ``source`` (session, t, seq, x); blocks are not needed on short sessions."""
    b = 1 - alpha
    return f"""{name}0 AS (SELECT *, row_number() OVER ({P} {O}) - 1 AS n FROM ({source})),
{name}1 AS (SELECT *, sum(CASE WHEN n = 0 THEN x ELSE {alpha}::DOUBLE * x END * pow({b}::DOUBLE, -n)) OVER ({P} {O}) * pow({b}::DOUBLE, n) AS m FROM {name}0),
{name}2 AS (SELECT *, lag(m) OVER ({P} {O}) AS m0 FROM {name}1),
{name}3 AS (SELECT *, sum(CASE WHEN n = 0 THEN 0 ELSE {alpha}::DOUBLE * {b}::DOUBLE * (x - m0) * (x - m0) * pow({b}::DOUBLE, -n) END) OVER ({P} {O}) * pow({b}::DOUBLE, n) AS v FROM {name}2),
{name} AS (SELECT *, coalesce((x - m0) / greatest(sqrt(lag(v) OVER ({P} {O})), 0.005 * abs(m0) + 1e-6), 0) AS z FROM {name}3)"""


_SMOOTHED = {
    "latency": "SELECT station, connector, sid, seq, t, req_res_latency AS x FROM trk WHERE req_res_latency IS NOT NULL",
    "gap": f"SELECT station, connector, sid, seq, t, dt_v2g AS x FROM (SELECT *, lag(phase) OVER ({P} {O}) AS was FROM trk) WHERE was = 'delivery' AND dt_v2g IS NOT NULL",
    "v_ripple": "SELECT station, connector, sid, seq, t, evse_v AS x FROM trk WHERE phase = 'delivery' AND evse_v IS NOT NULL",
    "i_ripple": "SELECT station, connector, sid, seq, t, evse_i AS x FROM trk WHERE phase = 'delivery' AND evse_i IS NOT NULL",
}
_SLOPE = f"""so AS (SELECT seq, t - first_value(t) OVER w AS dt, soc - first_value(soc) OVER w AS ds, remaining_full_min - first_value(remaining_full_min) OVER w AS dr
  FROM ses WHERE soc IS NOT NULL WINDOW w AS ({P} {O} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
slope AS (SELECT seq, CASE WHEN dt > 0 THEN ds / dt END AS soc_rate, CASE WHEN dt / 60 > 0.05 THEN dr / (dt / 60) + 1 END AS remaining_trend FROM so)"""
# trk with the smoothed scores and slopes
FULL = TRACK + ", " + ", ".join(ewm(f"z_{n}", q) for n, q in _SMOOTHED.items()) + ", " + _SLOPE + ", full_trk AS (SELECT trk.*, soc_rate, remaining_trend, " + ", ".join(f"coalesce(z_{n}.z, 0) AS {n}_z" for n in _SMOOTHED) + " FROM trk LEFT JOIN slope USING (seq) " + " ".join(f"LEFT JOIN z_{n} ON z_{n}.seq = trk.seq" for n in _SMOOTHED) + ")"
LEGACY = f"""leg AS (SELECT {K3}, t_end AS t, 'SESSION_ABORT' AS family FROM rest WHERE ({K3}) NOT IN (SELECT ({K3}) FROM reset)),
cand_l AS (SELECT * FROM cand WHERE ({K3}, family) NOT IN (SELECT ({K3}, family) FROM evid) UNION ALL FROM leg),
ff_l AS (SELECT {K3}, family, min(t) AS t FROM cand_l GROUP BY ALL),
lab_l AS (SELECT f.*, a.first_fault_t, a.first_fault_family, coalesce(a.families, []) AS families, coalesce(a.n, 0) AS n_faults
  FROM fct f LEFT JOIN (SELECT {K3}, min(t) AS first_fault_t, arg_min(family, (t, family)) AS first_fault_family, list_sort(list(family)) AS families, count(*) AS n FROM ff_l GROUP BY ALL) a USING ({K3}))"""
OUTCOME = "CASE WHEN first_fault_t IS NOT NULL THEN CASE WHEN a.t IS NULL THEN 'miss' WHEN a.t <= first_fault_t + 10 THEN 'tp' ELSE 'late' END ELSE CASE WHEN a.t IS NULL THEN 'quiet' ELSE 'fp' END END"
SCORED_L = SCORED + f""", {LEGACY},
sc_l AS (SELECT l.*, d.detector, a.t AS alert_t, a.guess, {OUTCOME} AS outcome, CASE WHEN first_fault_t IS NOT NULL AND a.t <= first_fault_t + 10 THEN greatest(0, first_fault_t - a.t) END AS lead
  FROM lab_l l CROSS JOIN (VALUES ('Spec'), ('Conformance')) d(detector) LEFT JOIN al a ON a.station = l.station AND a.connector = l.connector AND a.sid = l.sid AND a.detector = d.detector)"""


def hashed(*columns: str, seed: int = 42) -> str:
    """The order that samples and splits are drawn in."""
    return f"CAST('0x' || left(md5(concat_ws('|', {seed}, {', '.join(columns)})), 15) AS BIGINT)"


HOLDOUT = f"""so AS (SELECT station, count(*) OVER (ORDER BY h, station) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT station, {hashed('station')} AS h FROM tel)),
ho AS (SELECT station, CASE WHEN place < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM so)"""
