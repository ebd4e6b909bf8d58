"""Selection by counting, sampling by hash ranges, intervals, investigations, lenses, streams with timers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_labels import events
from voltline.functions import catalogue as FC
from voltline.operators import captures as C
from voltline.operators import features as X
from voltline.operators import labels as G
from voltline.operators import scoring as R
from voltline.operators import sessions as Z
from voltline.operators import stateful as SF
from voltline.operators import training as T
from voltline.streaming import live

KEY = {"station": "S", "connector": "connector1", "sid": 0}


def test_order_statistics_equal_sorting(spark):
    rng = random.Random(1)
    given = {k: [rng.choice([0.0, 0.5, rng.random(), rng.random() * 1000, 120.0]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000))}
    df = spark.createDataFrame([(k, x) for k, v in given.items() for x in v] + [("e", None)], "k string, x double")
    got = {r.k: r for r in R.order_statistics(df, "x", {"mid": F.floor(F.col("n") / 2), "p99": F.bround((F.col("n") - 1) * 0.99, 0)}, "k").collect()}
    assert set(got) == set(given)
    for k, v in given.items():
        assert (got[k].mid, got[k].p99) == (sorted(v)[len(v) // 2], sorted(v)[round(0.99 * (len(v) - 1))])


def test_least_by_hash_equals_sorting(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    for n in (0, 1, 7, 2999, 3000, 9000):
        wanted = {r.k for r in df.orderBy(T.hash_order("k"), "k").limit(n).collect()}
        assert {r.k for r in T.least_by_hash(df, n, "k").collect()} == wanted


def test_intervals_equal_a_loop(spark):
    rng = random.Random(3)
    times = sorted(round(rng.uniform(0, 100), 1) for _ in range(150))
    rows = spark.createDataFrame([("S", "c", 0, t, i) for i, t in enumerate(times)], "station string, connector string, sid int, t double, seq int")
    spans = [(a, a + w) for a in (0.0, 5.0, *times[::9]) for w in (1.0, 10.0)]
    df = spark.createDataFrame([("S", "c", 0, a, b) for a, b in spans], "station string, connector string, sid int, a double, b double")
    got = {(r.a, r.b): r for r in G.interval_counts(rows, df, 1.5).collect()}
    for a, b in set(spans):
        inside = [t for t in times if a <= t <= b]
        edges = [a, *inside, b]
        ok = bool(inside) and max(y - x for x, y in zip(edges, edges[1:])) <= 1.5
        r = got[a, b]
        assert (r.n, r.n_after, r.widest_ok) == (len(inside), sum(a < t <= b for t in times), ok)


def test_ewm_over_block_edges_equals_the_recurrence(spark):
    rng = random.Random(4)
    xs = [rng.uniform(-5, 50) for _ in range(3 * X.BLOCK + 17)]
    df = spark.createDataFrame([("S", "c", 0, float(i), i, x) for i, x in enumerate(xs)], "station string, connector string, sid int, t double, seq int, x double")
    mean = var = None
    for r, x in zip(X.ewm_readings(df, "x", "e", *Z.SESSION).orderBy("seq").collect(), xs):
        if mean is None:
            mean, var, z = x, 0.0, 0.0
        else:
            z = (x - mean) / max(var**0.5, 0.005 * abs(mean) + 1e-6)
            d = x - mean
            mean, var = mean + 0.05 * d, 0.95 * (var + 0.05 * d * d)
        assert (r.e_mean, r.e_var, r.e_z) == pytest.approx((mean, var, z), rel=1e-9, abs=1e-9)


def test_message_breaches_count_once(spark):
    rows = [(0, "v2g", "SessionSetupReq"), (1, "hpav", "CM_LINK_STATUS.CNF"), (2.5, "hpav", "CM_LINK_STATUS.CNF"), (3, "hpav", "CM_LINK_STATUS.CNF"), (4, "v2g", "SessionSetupRes"), (5, "v2g", "ServiceDiscoveryReq"), (9, "v2g", "ServiceDiscoveryRes")]
    out = X.message_timers(X.dialogs(Z.sessionize(events(spark, rows)))).orderBy("seq").collect()
    assert [r.n_msg_breach for r in out] == [0, 0, 1, 1, 1, 1, 2]
    assert [r.last_timeout_msg for r in out] == ["", "", "SessionSetupReq", "SessionSetupReq", "SessionSetupReq", "", "ServiceDiscoveryReq"]


def test_stop_attribution_goes_in_order(spark):
    cases = {
        "A": ([(0, "hpav", "CM_SLAC_PARM.REQ")], None, ("not_applicable", None, "high")),
        "B": ([(0, "v2g", "SessionSetupReq"), (1, "v2g", "CurrentDemandRes", {"notification": "StopCharging"}), (2, "v2g", "SessionStopReq")], None, ("charger", "vehicle", "high")),
        "C": ([(0, "v2g", "CurrentDemandReq", {"charge_complete": "true"}), (2, "v2g", "SessionStopReq")], None, ("vehicle", "vehicle", "medium")),
        "D": ([(0, "v2g", "SessionStopReq"), (1, "v2g", "SessionStopRes", {"resp_code": "FAILED_SequenceError"})], ("PROTOCOL_FAILED", "x"), ("vehicle", "vehicle", "high")),
        "E": ([(0, "v2g", "PreChargeReq"), (1, "v2g", "PreChargeRes", {"resp_code": "FAILED"})], ("PROTOCOL_FAILED", "x"), ("charger", None, "high")),
        "F": ([(0, "v2g", "CableCheckReq")], ("COMM_FREEZE", "CableCheck stuck 70s"), ("charger", None, "medium")),
        "G": ([(0, "v2g", "CurrentDemandReq"), (1, "tcp", "RST")], None, ("unknown", None, "low")),
        "H": ([(0, "v2g", "CurrentDemandReq")], ("SESSION_ABORT", "re-SLAC mid-session (link drop)"), ("communication", None, "medium")),
        "I": ([(0, "v2g", "CurrentDemandReq"), (1, "v2g", "SessionStopReq")], None, ("vehicle", "vehicle", "medium")),
        "J": ([(0, "v2g", "CurrentDemandReq")], None, ("unknown", None, "low")),
    }
    rows = None
    for station, (given, _, _) in cases.items():
        part = Z.sessionize(events(spark, given, station))
        rows = part if rows is None else rows.unionByName(part)
    alerts = spark.createDataFrame([(s, "connector1", 0, *a) for s, (_, a, _) in cases.items() if a], "station string, connector string, sid int, fault_guess string, reason string")
    got = {r.station: (r.triggered_by, r.request_sender, r.confidence) for r in C.stop_attribution(rows, alerts).collect()}
    assert got == {s: want for s, (_, _, want) in cases.items()}


def test_families_are_resolved_from_reasons(spark):
    rows = [("ev_error", "", "EV_ERROR"), (None, "goal 'EVSE healthy' failed: x", "EVSE_FAULT"), ("odd", "TCP RST", "SESSION_ABORT"), ("odd", "nothing", "ODD"), ("", None, None), (None, "never reached CurrentDemand", "NO_POWER_DELIVERED")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, family string, reason string, want string")
    assert all(r.got == r.want for r in df.select("want", FC.resolve_family(F.col("family"), F.col("reason")).alias("got")).collect())
    party = {r.i: r.stop_party for r in FC.explained(df, "family", "reason").collect()}
    assert party[0] == "ev" and party[1] == "evse" and party[4] == "unknown"


def ledger(rows, ttl=15.0):
    """The first confirmed hypothesis of rows (t, opens, found)."""
    cases = {}
    for t, opens, found in rows:
        for h, need in opens:
            cases.setdefault(h, dict(since=t, need=need, ttl=ttl, sum=0.0, at={}, kinds=Counter()))
        for h, kind, weight, every, most in found:
            c = cases.get(h)
            if c is None:
                continue
            if weight is None:
                c["ttl"] = 0.0
            elif not (every and t - c["at"].get(kind, -1e9) < every):
                c["at"][kind] = t
                if most is None or c["kinds"][kind] + weight <= most:
                    c["kinds"][kind] += weight
                    c["sum"] += weight
        for h, c in list(cases.items()):
            if c["sum"] >= c["need"]:
                return t, h
            if t - c["since"] > c["ttl"]:
                del cases[h]
    return None


def test_investigations_equal_a_ledger(spark):
    rng = random.Random(8)
    given = {}
    for sid in range(40):
        rows, t = [], 0.0
        for _ in range(30):
            t += rng.choice([0.5, 2.0, 6.0])
            opens = [(rng.choice("ab"), 2.0)] if rng.random() < 0.3 else []
            found = [(rng.choice("ab"), rng.choice("xy"), rng.choice([0.4, 0.9, None]) if rng.random() < 0.2 else 0.5, rng.choice([0.0, 2.0]), rng.choice([None, 1.0])) for _ in range(rng.randrange(3))]
            rows.append((t, opens, found))
        given[sid] = rows
    schema = "station string, connector string, sid int, t double, seq int, opens array<struct<hypothesis: string, need: double>>, found array<struct<hypothesis: string, kind: string, weight: double, every: double, most: double>>"
    df = spark.createDataFrame([("S", "c", s, t, i, o, f) for s, rows in given.items() for i, (t, o, f) in enumerate(rows)], schema)
    got = {r.sid: (r.t, r.reason.split("'")[1]) for r in SF.investigations(df).collect()}
    assert got == {s: x for s, rows in given.items() if (x := ledger(rows))}


def test_streamed_first_alerts_and_timers(spark, tmp_path):
    def write(name, rows, station):
        events(spark, rows, station).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    base = 1_700_000_000
    write("1", [(base, "v2g", "SessionSetupReq"), (base + 0.5, "v2g", "SessionSetupRes", {"resp_code": "FAILED"})], "MARK")
    write("2", [(base, "v2g", "SessionSetupReq")], "SILENT")  # nothing follows: only the watermark can tell
    write("3", [(base, "v2g", "SessionSetupReq"), (base + 0.1, "v2g", "SessionSetupRes"), (base + 1, "v2g", "SessionStopReq"), (base + 1.1, "v2g", "SessionStopRes")], "CLEAN")
    schema = spark.read.parquet(str(tmp_path / "in" / "1")).schema
    stream = live.with_time(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).withWatermark("ts", "1 second")
    write("4", [(base + 900, "v2g", "CurrentDemandReq"), (base + 900.1, "v2g", "CurrentDemandRes")], "LATER")
    write("5", [(base + 901, "v2g", "SessionStopReq"), (base + 901.1, "v2g", "SessionStopRes")], "LATER")
    out = str(tmp_path / "out")
    live.upsert(live.first_alerts(stream), out, str(tmp_path / "cp")).awaitTermination()
    got = {r.station: (r.family, round(r.t - base, 3)) for r in spark.read.schema(f"{live.ALERT}, batch int").parquet(out).collect()}
    assert got["MARK"] == ("PROTOCOL_FAILED", 0.5) and got["SILENT"] == ("COMM_FREEZE", 2.0) and "CLEAN" not in got
