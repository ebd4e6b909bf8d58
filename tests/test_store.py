"""Scans by bucket, stores, numbering and keyed tables; this module runs the plans that Spark generates code for."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from voltline.functions import scalars as S
from voltline.operators import features as X
from voltline.operators import sessions as Z
from voltline.operators import training as T
from voltline.sources import frames, telemetry
from voltline.streaming import live, stateful, upserts


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def store(df, label, folder):
    path = f"{folder}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def synthetic(spark, n=3000, seed=5):
    """One connector with nine tenths of all rows, gaps of every kind and long quiet stretches."""
    rng = random.Random(seed)
    rows, t = [], {}
    kinds = [("v2g", "CurrentDemandReq"), ("v2g", "SessionStopRes"), ("v2g", "SessionSetupReq"), ("hpav", "CM_LINK_STATUS.CNF"), ("tcp", "RST"), ("hpav", "CM_SLAC_PARM.REQ")]
    for seq in range(n):
        connector = "hot" if rng.random() < 0.9 else f"c{rng.randint(0, 3)}"
        kind, msg = rng.choices(kinds, [5, 2, 2, 8 if seq % 700 > 300 else 60, 1, 1])[0]
        t[connector] = t.get(connector, 0.0) + rng.choice([0.0, 0.04, 0.3, 5.0, 9.0, 30.0, 59.9, 60.0, 60.1, 200.0] if seq % 5 == 0 else [0.0, 0.02, 0.1])
        rows.append((seq, t[connector], "S", connector, kind, msg))
    return spark.createDataFrame(rows, "seq bigint, t double, station string, connector string, kind string, msg string")


@pytest.mark.parametrize("bucket_s", [7.0, 60.0, 1000.0, 1e9])
def test_scan_by_bucket_equals_scan(spark, bucket_s):
    rows = synthetic(spark)
    one = {r.seq: r.sid for r in Z.sessionize(rows).collect()}
    assert 0 < len(one) < rows.count()
    assert {r.seq: r.sid for r in Z.sessionize(rows, bucket_s=bucket_s).collect()} == one


def test_hot_connector_uses_many_tasks(spark):
    rows = synthetic(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in Z.sessionize(rows, bucket_s=20.0).groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in Z.sessionize(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(plain) > 0.8 * sum(plain) and max(sizes) < 0.4 * sum(sizes)


def test_session_store_needs_no_shuffle(spark, sf, tmp_path):
    rows = frames.session_store(Z.sessionize(telemetry.fixture(spark, sf)), str(tmp_path / "store"), 4)
    phases = X.phases(rows)
    plan = phases._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search(r"\bExchange\b", plan)
    assert phases.count() == rows.count()


def test_ring_files_name_and_size(spark, sf, tmp_path):
    events = telemetry.fixture(spark, sf)
    frames.write_ring_files(events, str(tmp_path / "rings"), 1800.0)
    rows = frames.read_ring_files(spark, str(tmp_path / "rings"), events.schema)
    spans = frames.file_spans(rows)
    assert rows.count() == events.count() == spans.agg(F.sum("n_rows")).first()[0]
    assert spans.where("size_bytes <= 0 OR NOT contains(file, station)").count() == 0
    assert Z.dedupe_ring_files(spans).count() == spans.count()


def test_ring_files_are_packed(spark, sf, tmp_path):
    events = telemetry.fixture(spark, sf)
    for copy in (0, 1):
        frames.write_ring_files(events, str(tmp_path / "rings"), 60.0, copy)
    spans = frames.file_spans(frames.read_ring_files(spark, str(tmp_path / "rings"), events.schema)).collect()
    lines = {(r.station, r.connector, r.slot): r.n for r in events.groupBy("station", "connector", F.floor(F.col("t") / 60).alias("slot")).agg(F.sum(F.length(F.to_json(F.struct(*events.columns))) + 1).alias("n")).collect()}
    assert {(r.copy, r.station, r.connector, r.slot): r.size_bytes for r in spans} == {(c, *k): n for c in (0, 1) for k, n in lines.items()}
    assert len({r.file for r in spans}) == len(spans) == 2 * len(lines) > 200
    assert len(list((tmp_path / "rings").rglob("*.parquet"))) <= 16  # a pack for each of eight tasks and each fetch


def test_numbers_follow_the_order_of_keys(spark, tmp_path):
    rng = random.Random(2)
    keys = {(f"S{rng.randint(0, 40)}", rng.choice("ab"), rng.randint(0, 30)) for _ in range(900)}
    df = spark.createDataFrame(sorted(keys, key=lambda k: hash(k)), "station string, connector string, sid int")
    counter = iter(range(9))
    for least in (10, 100, 10_000):
        found = T.globally_numbered(df, lambda d, label: store(d, f"{label}{next(counter)}", tmp_path), least)
        assert [tuple(r)[:3] for r in found.orderBy("number").collect()] == sorted(keys)
        assert [r.number for r in found.orderBy("number").collect()] == list(range(len(keys)))


def test_typed_fields_of_bad_json(spark):
    df = spark.createDataFrame([('{"k": 3, "s": "x", "o": {"a": 1}}',), ('{"k": "no"}',), ('{"k": 3',), ("",), (None,), ("[1]",)], "extra string")
    found = df.select(*[c.alias(n) for n, c in S.extra_fields(F.col("extra"), k="int", s="string", z="int").items()]).collect()
    assert [tuple(r) for r in found] == [(3, "x", None)] + [(None, None, None)] * 5


def test_percent_of_decides_halves_upwards(spark):
    df = spark.createDataFrame([(5, 16), (1, 16), (1, 2000), (0, 3), (3, 3), (2, 0), (1, 3)], "p bigint, w bigint")
    assert [r[0] for r in df.select(S.percent_of(F.col("p"), F.col("w"))).collect()] == ["31.3%", "6.3%", "0.1%", "0.0%", "100.0%", None, "33.3%"]


def test_clones_have_the_same_files(spark):
    rows = [(s, f"f{i}", f"h{i if s != 'C' or i else 9}") for s in "ABC" for i in range(30)] + [("D", "f0", "h0")]
    found = Z.collapse_clones(spark.createDataFrame(rows, "station string, file string, sha256 string"), 4)
    assert {r.station: r.canonical for r in found.collect()} == {"A": "A", "B": "A", "C": "C", "D": "D"}


def test_keyed_table_merges_replays_and_stays_small(spark, tmp_path):
    schema = ST.StructType.fromDDL("k int, x int, y string")
    table = upserts.KeyedTable(spark, str(tmp_path / "table"), schema, ("k",), "x", merge_every=3)
    assert table.read().count() == 0
    due = {}
    for batch in range(11):
        rows = [(batch + i, 10 * batch + i, None if i % 2 else f"b{batch}") for i in range(4)] + [(batch, -5, "older")]
        assert table.apply(spark.createDataFrame(rows, schema), batch)
        due |= {k: (x, y) for k, x, y in rows[:4]}
        assert not table.apply(spark.createDataFrame([(0, 999, "replayed")], schema), batch)
        assert {r.k: (r.x, r.y) for r in table.read().collect()} == due
    folders = [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith(("delta-", "snapshot-"))]
    assert len(folders) <= 5 and len(table._versions()) == 2
    first = table.pinned(7, "r")
    table.apply(spark.createDataFrame([(0, 1, "z")], schema), 11)
    assert table.pinned(7, "r") == first < table.pinned(8, "r")


def rows_of(spark, rows):
    full = {f.name: None for f in telemetry.EVENT_SCHEMA} if hasattr(telemetry, "EVENT_SCHEMA") else {}
    base = {"station": "S", "connector": "c", "resp_code": "", "evse_status": "", "isolation": "", "ev_err": "", "evse_processing": "", "ev_max_v": None, "evse_v": None}
    names = "seq bigint, t double, kind string, msg string, station string, connector string, resp_code string, evse_status string, isolation string, ev_err string, evse_processing string, ev_max_v double, evse_v double"
    order = [n.split()[0] for n in names.split(", ")]
    return spark.createDataFrame([tuple((full | base | {"seq": i} | r)[c] for c in order) for i, r in enumerate(rows)], names)


def test_stream_of_shuffled_rows_equals_batch(spark, tmp_path):
    """Rows that arrive out of order, in two batches, within the lateness."""
    rows = synthetic(spark, 1200, seed=8).where("connector <> 'hot' OR seq % 3 = 0")
    end = rows.agg(F.max("t")).first()[0]
    for i in range(2):
        rows.where(f"pmod(hash(seq), 2) = {i} OR t > {end - 1}").orderBy(F.hash("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.with_time(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).withWatermark("ts", f"{int(end) + 100} seconds")
    closer = rows.groupBy("station", "connector").agg(F.max("seq").alias("seq")).withColumns({"t": F.lit(3 * end + 1000.0), "kind": F.lit("tcp"), "msg": F.lit("RST")})
    closer.select(rows.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.upsert(stateful.closed_sessions(stream.dropDuplicatesWithinWatermark(["connector", "seq", "t"])), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.connector, r.sid): (r.n_events, r.seq_sum) for r in spark.read.schema(f"{stateful.SESSION_OUT}, batch int").parquet(str(tmp_path / "out")).collect()}
    due = Z.sessionize(rows).groupBy("connector", "sid").agg(F.count("*").alias("n"), F.sum("seq").alias("s")).collect()
    assert got == {(r.connector, r.sid): (r.n, r.s) for r in due}


def test_silence_alerts_without_rows(spark, tmp_path):
    rows = rows_of(spark, [
        {"t": 10.0, "kind": "v2g", "msg": "SessionSetupReq"},
        {"t": 10.5, "kind": "v2g", "msg": "SessionSetupRes"},
        {"t": 11.0, "kind": "v2g", "msg": "CableCheckReq"},
        {"t": 5000.0, "kind": "tcp", "msg": "RST", "connector": "other"},
    ])
    found = {}
    for timers in (False, True):
        folder = tmp_path / str(timers)
        rows.write.parquet(str(folder / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(folder / "in"))
        live.upsert(stateful.stream_alerts(stream, "10 seconds", timers), str(folder / "out"), str(folder / "cp")).awaitTermination()
        alerts = spark.read.schema(f"{stateful.ALERT_OUT}, batch int").parquet(str(folder / "out")).collect()
        found[timers] = {(r.connector, r.sid, r.detector, r.t, r.fault_guess) for r in alerts}
    assert found[False] == set()
    assert found[True] == {("c", 0, "Conformance", 13.0, "COMM_FREEZE"), ("c", 0, "Spec", 51.0, "COMM_FREEZE")}
