"""Hand-made rows with known labels."""

import pytest
from pyspark.sql import functions as F

from voltline.operators import detection as D
from voltline.operators import features as X
from voltline.operators import labels as G
from voltline.operators import sessions as Z
from voltline.sources import telemetry as T

BLANK = {c: "" for c in T.TEXT} | {"station": "S", "connector": "connector1"}


def events(spark, rows, station="S"):
    """Rows (t, kind, msg, {fields}) of one connector as telemetry."""
    data = []
    for i, (t, kind, msg, *more) in enumerate(rows):
        r = BLANK | {"seq": i, "t": str(t), "kind": kind, "msg": msg, "station": station} | {k: str(v) for k, v in (more[0] if more else {}).items()}
        data.append(tuple(r.get(c) for c in [x.split()[0] for x in T.RAW_SCHEMA.split(", ")]))
    return T.typed(spark.createDataFrame(data, T.RAW_SCHEMA))


def v2g(*pairs):
    return [(t, "v2g", m) for t, m in pairs]


def labels(spark, rows, profile="strict"):
    out = G.label_sessions(Z.sessionize(events(spark, rows)), profile).orderBy("sid").collect()
    return [({f.family: round(f.t, 3) for f in r.faults}, r) for r in out]


def retx(start, n, step=0.01):
    return [(start + i * step, "tcp", "RETX") for i in range(n)]


def polls(start, end, step):
    n = int((end - start) / step)
    return [(start + i * step, "hpav", "CM_LINK_STATUS.CNF") for i in range(n + 1)]


def by_time(*groups):
    return sorted((r for g in groups for r in g), key=lambda r: r[0])


def test_a_reopened_dialog_splits_the_session(spark):
    rows = v2g((0, "SessionSetupReq"), (0.1, "SessionSetupRes"), (1, "SessionStopReq"), (1.1, "SessionStopRes"), (2, "SessionSetupReq"), (2.1, "SessionSetupRes"))
    found = labels(spark, rows)
    assert len(found) == 2 and found[0][1].graceful_close and not found[1][1].graceful_close


def test_gap_of_exactly_the_limit_stays(spark):
    rows = v2g((0, "SessionSetupReq"), (60, "SessionSetupRes"), (120.5, "CurrentDemandReq"))
    assert [r.sid for r in Z.sessionize(events(spark, rows)).orderBy("seq").collect()] == [0, 0, 1]


def test_late_quiet_rows_join_the_next_session_or_none(spark):
    rows = v2g((0, "SessionSetupReq")) + [(50, "hpav", "CM_LINK_STATUS.CNF"), (100, "hpav", "CM_LINK_STATUS.CNF"), (195, "hpav", "CM_LINK_STATUS.CNF")] + v2g((200, "SessionSetupReq"))
    assert [(r.seq, r.sid) for r in Z.sessionize(events(spark, rows)).orderBy("seq").collect()] == [(0, 0), (1, 0), (3, 1), (4, 1)]


@pytest.mark.parametrize(("n", "abort"), [(19, False), (20, True)])
def test_twenty_rows_prove_a_live_link(spark, n, abort):
    [(faults, _)] = labels(spark, v2g((0, "CurrentDemandReq")) + retx(0.3, n))
    assert ("SESSION_ABORT" in faults) == abort


def test_far_rows_are_no_evidence(spark):
    found = labels(spark, v2g((0, "SessionSetupReq")) + retx(55, 20))
    assert all("SESSION_ABORT" not in f for f, _ in found)


@pytest.mark.parametrize(("stream", "abort"), [("0", False), ("1", True)])
def test_a_reset_counts_on_the_own_stream(spark, stream, abort):
    rows = [(0, "v2g", "SessionSetupReq", {"tcp_stream": "1"}), (1, "tcp", "RST", {"tcp_stream": stream})]
    [(faults, _)] = labels(spark, rows)
    assert ("SESSION_ABORT" in faults) == abort


def test_ongoing_ends_with_its_phase(spark):
    rows = [(0, "v2g", "CableCheckRes", {"evse_processing": "Ongoing"}), (1, "v2g", "PreChargeRes")] + retx(50, 30) + retx(70, 30)
    [(_, r)] = labels(spark, rows)
    assert not any("Ongoing" in f.detail for f in r.faults)


def test_reviewed_ignores_the_payload_of_failed_rows(spark):
    rows = [(0, "v2g", "CableCheckRes", {"resp_code": "FAILED", "evse_status": "EVSE_Malfunction", "isolation": "Fault"})]
    [(faults, _)] = labels(spark, rows, "reviewed")
    assert set(faults) == {"PROTOCOL_FAILED"}
    [(faults, _)] = labels(spark, rows)
    assert set(faults) == {"PROTOCOL_FAILED", "EVSE_FAULT", "ISOLATION_FAULT"}


def test_reviewed_cable_check_takes_forty_seconds(spark):
    rows = v2g((0, "CableCheckReq")) + [(t, "v2g", "CableCheckRes", {"evse_processing": "Ongoing"}) for t in range(1, 42)]
    [(faults, _)] = labels(spark, rows, "reviewed")
    assert faults["COMM_FREEZE"] == 40.0


@pytest.mark.parametrize(("measured", "family"), [(100, "PRECHARGE_FAULT"), (1200, None)])
def test_precharge_must_converge_unless_decoding_is_in_doubt(spark, measured, family):
    rows = [(t / 2, "v2g", "PreChargeReq" if t % 2 == 0 else "PreChargeRes", {"ev_target_v": 500, "evse_v": measured}) for t in range(25)]
    [(faults, r)] = labels(spark, rows, "reviewed")
    assert ("PRECHARGE_FAULT" in faults) == (family is not None) and (len(r.quality_flags) > 0) == (family is None)


def test_reviewed_censors_a_shared_medium(spark):
    rows = [(t, "hpav", "CM_SLAC_PARM.REQ") for t in range(3)]
    [(faults, r)] = labels(spark, rows, "reviewed")
    assert not faults and r.censored and "shared" in r.censor_reason
    [(faults, _)] = labels(spark, rows)
    assert set(faults) == {"SLAC_FAILURE"}


def test_no_power_after_a_proper_close(spark):
    rows = v2g((0, "SessionSetupReq"), (1, "ChargeParameterDiscoveryReq"), (2, "CableCheckReq"), (3, "SessionStopReq"), (3.1, "SessionStopRes"))
    [(faults, r)] = labels(spark, rows)
    assert faults == {"NO_POWER_DELIVERED": 3.0} and r.graceful_close


@pytest.mark.parametrize(("rows", "mode", "alert"), [
    ([(0, "CM_SLAC_MATCH.REQ"), (0.2, "CM_SLAC_MATCH.REQ"), (0.59, "CM_LINK_STATUS.CNF")], "normative", False),
    ([(0, "CM_SLAC_MATCH.REQ"), (0.2, "CM_SLAC_MATCH.REQ"), (0.61, "CM_LINK_STATUS.CNF")], "normative", True),
    ([(0, "CM_ATTEN_CHAR.RSP"), (9.99, "CM_LINK_STATUS.CNF")], "normative", False),
    ([(0, "CM_ATTEN_CHAR.RSP"), (10.01, "CM_LINK_STATUS.CNF")], "normative", True),
    ([(0, "CM_SLAC_MATCH.REQ"), (0.61, "CM_LINK_STATUS.CNF"), (9.99, "CM_LINK_STATUS.CNF")], "empirical", False),
    ([(0, "CM_SLAC_MATCH.REQ"), (10.01, "CM_LINK_STATUS.CNF")], "empirical", True),
])
def test_matching_budgets(spark, rows, mode, alert):
    s = Z.sessionize(events(spark, [(t, "hpav", m) for t, m in rows]))
    assert (D.first_alerts(D.matching_rules(X.matching(s), mode), "m").count() == 1) == alert


def test_own_traffic_silences_the_matching_rule(spark):
    rows = [(0, "hpav", "CM_SLAC_MATCH.REQ"), (0.1, "v2g", "SessionSetupReq"), (1.0, "hpav", "CM_LINK_STATUS.CNF")]
    assert D.first_alerts(D.matching_rules(X.matching(Z.sessionize(events(spark, rows))), "both"), "m").count() == 0


def test_artifacts_at_a_cut_go(spark):
    cuts = spark.createDataFrame([("S", "c", 100.0)], "station string, connector string, cut double")
    fault = "array<struct<t: double, family: string>>"
    rows = [(1, 98.0, False, []), (2, 50.0, False, []), (3, 98.0, True, []), (4, 99.0, False, [(97.0, "SESSION_ABORT")]), (5, 99.0, False, [(97.0, "SESSION_ABORT"), (1.0, "EV_ERROR")])]
    df = spark.createDataFrame([("S", "c", i, e, g, f) for i, e, g, f in rows], f"station string, connector string, sid int, t_end double, graceful boolean, faults {fault}")
    assert sorted(r.sid for r in Z.drop_truncation_artifacts(df, cuts).collect()) == [2, 3, 5]


def test_smoothing_over_blocks_equals_a_loop(spark):
    rng = [((i * 7919) % 101) / 10 for i in range(1300)]
    df = spark.createDataFrame([("S", "c", 0, float(i), i, x) for i, x in enumerate(rng)], "station string, connector string, sid int, t double, seq int, x double")
    got = {r.seq: (r.e_mean, r.e_z) for r in X.ewm(df, "x", "e").collect()}
    mean = var = None
    for i, x in enumerate(rng):
        z = 0.0 if mean is None else (x - mean) / max(var**0.5, 0.005 * abs(mean) + 1e-6)
        assert got[i][1] == pytest.approx(z, abs=1e-6)
        d = 0.0 if mean is None else x - mean
        mean, var = (x, 0.0) if mean is None else (mean + 0.05 * d, 0.95 * (var + 0.05 * d * d))
        assert got[i][0] == pytest.approx(mean, abs=1e-9)


def test_evidence_board_equals_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(float(i) + rng.random(), rng.choice([None, None, rng.random()]), rng.choice([None, 0.96, 0.4])) for i in range(300)]
    df = spark.createDataFrame([("S", "c", 0, t, i, a, b) for i, (t, a, b) in enumerate(rows)], "station string, connector string, sid int, t double, seq int, a double, b double")
    got = {r.seq: r for r in D.evidence_board(df, {"a": F.col("a"), "b": F.col("b")}).collect()}
    board = {}
    for i, (t, *posts) in enumerate(rows):
        for name, w in zip("ab", posts):
            if w is not None and (name not in board or w >= board[name][0] * 0.5 ** ((t - board[name][1]) / 20)):
                board[name] = (w, t)
        now = {n: w * 0.5 ** ((t - at) / 20) for n, (w, at) in board.items()}
        keep = 1.0
        for n, x in now.items():
            keep *= 1 - min(x, 0.99) if x >= 0.05 else 1
        assert got[i].belief == pytest.approx(1 - keep, abs=1e-6)
        assert got[i].is_critical == any(x >= 0.05 and board[n][0] >= 0.95 for n, x in now.items())
