"""Queries of dataset curation, training sets and windows in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curation as C
from ..operators import detection as D
from ..operators import features as X
from ..operators import sessions as Z
from ..operators import training as T
from ..sources import telemetry
from ..streaming import live
from . import oracle_base as O
from .feature_queries import _SPANS, VECTOR_SQL, micros, numbers, numbers_sql, query, smoothed, us
from .label_queries import K3, labels, sessions, tracked
from .tables import stored

FILES = """files AS (SELECT source AS batch, doc_id AS file_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS size, n_chars FROM documents),
dd AS (SELECT *, row_number() OVER (PARTITION BY batch, sha256 ORDER BY file_id) = 1 AS kept, CASE WHEN file_id % 101 = 7 THEN 'unsafe_path' WHEN file_id % 101 = 8 THEN 'ignored' WHEN file_id % 101 IN (9, 10) THEN 'encrypted_or_linked' WHEN file_id % 101 = 11 THEN 'method' WHEN size <= 0 THEN 'empty' WHEN size > 536870912 THEN 'too_large' WHEN size > 65536 AND file_id % 2 = 0 THEN 'ratio' WHEN size < 40 THEN 'bad_magic' END AS reason, min(batch) OVER (PARTITION BY sha256) AS fb FROM files),
fl AS (SELECT * EXCLUDE (fb), kept AND fb < batch AS reused FROM dd),
rv AS (SELECT f.sha256, min(CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 1 THEN 'normal' ELSE 'fault' END) AS classification FROM files f JOIN labels l ON l.doc_id = f.file_id GROUP BY ALL)"""


def files(s, d) -> DataFrame:
    """Documents as the files of capture batches: a source is a batch, the text its content."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    body = F.coalesce("text", F.lit(""))
    f = docs.select(F.col("source").alias("batch"), F.col("doc_id").alias("file_id"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("size"))
    # an archive's entries: name, flags, method and ratio follow from the number of the document, the first bytes from its size
    k = F.col("file_id") % 101
    path = F.when(k == 7, "../a.pcap").when(k == 8, "notes.txt").otherwise("day/a.pcap")
    ratio, magic = F.when(F.col("file_id") % 2 == 0, 250.0).otherwise(3.0), F.when(F.col("size") < 40, "00000000").otherwise(C.MAGICS[0])
    reason = C.rejection_reason(F.col("size"), ratio, path, magic, k == 9, k == 10, F.when(k == 11, 14).otherwise(8))
    return C.content_dedupe(f).withColumn("reason", reason)


def reviews(s, d) -> DataFrame:
    l = s.read.parquet(f"{d}/labels.parquet").join(files(s, d).select("file_id", "sha256"), F.col("doc_id") == F.col("file_id"))
    return l.groupBy("sha256").agg(F.min(F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "normal").otherwise("fault")).alias("classification"))


@query("k1_content_dedupe", f"WITH {FILES} SELECT file_id, kept, reused FROM fl")
def k1(s, d):
    return files(s, d).select("file_id", "kept", "reused")


@query("k2_rejections", f"WITH {FILES} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM fl GROUP BY ALL")
def k2(s, d):
    return files(s, d).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("k3_batch_counters", f"WITH {FILES} SELECT batch, count(*) AS files, count(*) FILTER (kept AND reason IS NULL) AS kept, count(*) FILTER (NOT kept AND reason IS NULL) AS duplicates, count(*) FILTER (reused) AS reused, count(*) FILTER (reason IS NOT NULL) AS rejected, CAST(coalesce(sum(size) FILTER (kept AND reason IS NULL), 0) AS BIGINT) AS bytes, CASE WHEN count(*) FILTER (kept AND reason IS NULL) = 0 THEN 'failed' ELSE 'ready' END AS status FROM fl GROUP BY ALL")
def k3(s, d):
    return C.batch_counters(files(s, d))


_REV = "rev AS (SELECT sha256(coalesce(text, '')) AS sha256, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS revision, CASE WHEN doc_id % 3 = 0 THEN 'fault' WHEN doc_id % 3 = 1 THEN 'normal' ELSE 'exclude' END AS classification FROM documents)"


@query("k4_current_labels", f"WITH {_REV} SELECT sha256, CAST(max(revision) AS INT) AS revision, arg_max(classification, revision) AS classification FROM rev GROUP BY ALL")
def k4(s, d):
    f = files(s, d).withColumn("revision", F.row_number().over(Window.partitionBy("sha256").orderBy("file_id")))
    kind = F.when(F.col("file_id") % 3 == 0, "fault").when(F.col("file_id") % 3 == 1, "normal").otherwise("exclude")
    revisions = f.select("sha256", "revision", kind.alias("classification"), F.lit("EV_ERROR").alias("fault_family"), F.lit("r").alias("reviewer"))
    return C.current_labels(revisions).select("sha256", "revision", "classification")


_PROG = "pg AS (SELECT batch, count(*) AS contents, count(classification) AS labelled, 0::BIGINT AS invalid FROM fl LEFT JOIN rv USING (sha256) WHERE kept AND reason IS NULL GROUP BY ALL)"


@query("k5_label_progress", f"WITH {FILES}, {_PROG} SELECT *, CASE WHEN labelled = 0 THEN 'unlabeled' WHEN labelled < contents THEN 'partially_reviewed' ELSE 'reviewed' END AS state FROM pg")
def k5(s, d):
    return C.label_progress(files(s, d), reviews(s, d))


@query("k4_label_violations", f"WITH {_REV} SELECT sha256, CAST(revision AS INT) AS revision, 'family_without_fault' AS rule FROM rev WHERE classification <> 'fault' UNION ALL SELECT sha256, CAST(revision + 1 AS INT), 'revision_gap' FROM rev WHERE revision = 1")
def k4_violations(s, d):
    f = files(s, d).withColumn("revision", F.row_number().over(Window.partitionBy("sha256").orderBy("file_id")))
    kind = F.when(F.col("file_id") % 3 == 0, "fault").when(F.col("file_id") % 3 == 1, "normal").otherwise("exclude")
    # the first revision is numbered 2, so a number is left out
    rows = f.select("sha256", (F.col("revision") + 1).alias("revision"), kind.alias("classification"), F.lit("EV_ERROR").alias("fault_family"), F.lit("r").alias("reviewer"))
    return C.label_violations(rows).select("sha256", F.when(F.col("rule") == "revision_gap", F.col("revision")).otherwise(F.col("revision") - 1).alias("revision"), "rule")


@query("k6_training_snapshot", f"WITH {FILES}, {_PROG}, ch AS (SELECT sha256, min(batch) AS batch FROM fl SEMI JOIN (SELECT batch FROM pg WHERE labelled >= 0.3 * contents) USING (batch) WHERE kept AND reason IS NULL GROUP BY ALL) SELECT sha256, batch, classification FROM ch JOIN rv USING (sha256) WHERE classification <> 'exclude'")
def k6(s, d):
    return C.training_snapshot(files(s, d), reviews(s, d), 0.3)


@query("k7_store_totals", f"WITH {FILES}, u AS (SELECT sha256, max(size) AS size, count(*) AS n FROM fl WHERE reason IS NULL GROUP BY ALL) SELECT count(*) AS contents, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(n - 1) AS BIGINT) AS duplicates, (SELECT count(*) FROM fl WHERE reason IS NOT NULL) AS rejected FROM u")
def k7(s, d):
    return C.store_totals(files(s, d))


@query("k8_unreferenced", f"WITH {FILES} SELECT DISTINCT sha256 FROM fl WHERE sha256 NOT IN (SELECT sha256 FROM rv)")
def k8(s, d):
    contents = files(s, d).select("sha256").distinct()
    manifests = files(s, d).select("batch", F.lit(True).alias("readable")).distinct()
    return C.unreferenced(contents, reviews(s, d), manifests)


@query("k8_guarded", f"WITH {FILES} SELECT sha256 FROM fl WHERE false")
def k8_guarded(s, d):
    """One batch's manifest cannot be read, so nothing counts as unreferenced."""
    manifests = files(s, d).select("batch").distinct().withColumn("readable", F.col("batch") != F.min("batch").over(Window.partitionBy()))
    return C.unreferenced(files(s, d).select("sha256").distinct(), reviews(s, d), manifests)


@query("k9_next_window", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next FROM orders")
def k9(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct().withColumn("next", C.next_window(F.col("day")))


@query("t1_station_holdout", f"WITH {O.TEL}, {O.HOLDOUT} SELECT station, station AS site, 'main' AS \"group\", split FROM ho")
def t1(s, d):
    return T.station_holdout(telemetry.fixture(s, d))


@query("t2_step_labels", f"WITH {O.SES}, {O.LABELS} SELECT seq, CASE WHEN first_fault_t - t <= 60 THEN 1 ELSE 0 END AS y FROM ses JOIN lab USING ({K3})")
def t2(s, d):
    return T.step_labels(sessions(s, d), labels(s, d)).select("seq", "y")


@query("t3_negative_subsample", f"WITH {O.SES}, {O.LABELS}, st AS (SELECT {K3}, seq, CASE WHEN first_fault_t - t <= 60 THEN 1 ELSE 0 END AS y FROM ses JOIN lab USING ({K3})), rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {O.hashed('station', 'connector', 'sid', 'seq')}) AS k, least(400000, 8 * greatest(count(*) FILTER (y = 1) OVER (), 1000)) AS keep FROM st) SELECT {K3}, seq, y FROM rk WHERE y = 1 OR k <= keep")
def t3(s, d):
    return T.subsample_negatives(T.step_labels(sessions(s, d), labels(s, d))).select(*Z.SESSION, "seq", "y")


@query("t4_threshold", f"WITH {O.TRACK}, {O.LABELS}, m AS (SELECT {K3}, max(coalesce(dt_v2g, 0)) AS x FROM trk JOIN lab USING ({K3}) WHERE n_faults = 0 GROUP BY ALL) SELECT CAST(round(quantile_cont(x, 0.95) * 1e6) AS BIGINT) AS threshold_us FROM m")
def t4(s, d):
    scores = X.dialog_gap(sessions(s, d)).select(*Z.SESSION, F.coalesce("dt_v2g", F.lit(0.0)).alias("score"))
    return T.session_threshold(scores, labels(s, d)).select(*micros("threshold"))


@query("t5_windows", f"WITH {O.SES}, w AS (SELECT {K3}, row_number() OVER ({O.P} {O.O}) - 1 AS start, list(seq) OVER ({O.P} {O.O} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS w FROM ses) SELECT {K3}, CAST(start AS INT) AS start, CAST(list_sum(w) AS BIGINT) AS total FROM w WHERE len(w) = 4 AND start % 2 = 0")
def t5(s, d):
    w = T.sliding_windows(sessions(s, d), "seq", 4, 2)
    return w.select(*Z.SESSION, F.col("start").cast("int").alias("start"), F.aggregate("window", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("t6_capped_windows", f"WITH {O.SES}, w AS (SELECT {K3}, row_number() OVER ({O.P} {O.O}) - 1 AS start, count(*) OVER ({O.P} {O.O} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM ses) SELECT {K3}, start FROM w WHERE n = 4 AND start % 2 = 0 ORDER BY {O.hashed('station', 'connector', 'sid', 'start')} LIMIT 200")
def t6(s, d):
    w = T.sliding_windows(sessions(s, d), "seq", 4, 2).select(*Z.SESSION, "start")
    return T.capped(w, 200, *Z.SESSION, "start")


@query("t7_state_stack", f"WITH {O.SES}, w AS (SELECT *, first_value(seq) OVER ({O.P} {O.O}) AS f FROM ses) SELECT seq, concat_ws(',', coalesce(lag(seq, 3) OVER ({O.P} {O.O}), f), coalesce(lag(seq, 2) OVER ({O.P} {O.O}), f), coalesce(lag(seq, 1) OVER ({O.P} {O.O}), f), seq) AS stack FROM w")
def t7(s, d):
    return T.state_stack(sessions(s, d), "seq").select("seq", F.concat_ws(",", F.col("stack").cast("array<string>")).alias("stack"))


@query("t8_transitions", f"WITH {O.SES}, {O.LABELS} SELECT seq, CAST(round((CASE WHEN first_fault_t IS NULL THEN -1.5 WHEN t <= first_fault_t + 10 THEN 1 + least(greatest(first_fault_t - t, 0), 120) / 120 ELSE 0.2 END) * 1e6) AS BIGINT) AS alert_reward_us, lead(t) OVER ({O.P} {O.O}) IS NULL AS done FROM ses JOIN lab USING ({K3})")
def t8(s, d):
    return T.transitions(sessions(s, d), labels(s, d)).select("seq", *micros("alert_reward"), "done")


@query("t9_patch_labels", f"WITH {O.SCORED_L}, o AS (SELECT {K3}, first_fault_t AS a FROM lab_l), n AS (SELECT {K3}, first_fault_t AS b, true AS found FROM lab) SELECT count(*) AS sessions, count(*) FILTER (found AND (a IS NULL) <> (b IS NULL)) AS flipped, count(*) FILTER (abs(a - b) > 0.5) AS reanchored, count(*) FILTER (found IS NULL) AS missing FROM o LEFT JOIN n USING ({K3})")
def t9(s, d):
    from ..operators import labels as G

    old = G.label_sessions(sessions(s, d), "legacy").select(*Z.SESSION, F.col("first_fault_t").alias("old_t"))
    return T.patch_labels(old, labels(s, d))


@query("t10_clean_sample", f"WITH {O.SES}, {O.LABELS}, rk AS (SELECT *, row_number() OVER (PARTITION BY first_fault_t IS NULL ORDER BY {O.hashed('station', 'connector', 'sid')}) AS k FROM lab) SELECT {K3}, {us('first_fault_t')} FROM rk WHERE first_fault_t IS NOT NULL OR k <= 20")
def t10(s, d):
    return T.clean_sample(labels(s, d), 20).select(*Z.SESSION, *micros("first_fault_t"))


@query("t11_stage_split", f"WITH {O.SES.replace(O.TEL, O.TEL + ', ' + O.HOLDOUT)} SELECT {K3}, count(*) AS n FROM ses JOIN ho USING (station) WHERE split = 'test' GROUP BY ALL")
def t11(s, d):
    rows = sessions(s, d)
    return T.stage_split(rows, T.station_holdout(rows), "test").groupBy(*Z.SESSION).agg(F.count("*").alias("n"))


@query("a9_feature_matrix", f"WITH {O.FULL} SELECT dense_rank() OVER (ORDER BY station, connector, sid) - 1 AS session, seq, {numbers_sql(VECTOR_SQL)} FROM full_trk")
def a9(s, d):
    rows = stored(X.feature_vector(smoothed(s, d)), "steps")
    numbers_of = T.globally_numbered(rows.select(*Z.SESSION).distinct(), stored, least_rows=1000)
    return rows.join(numbers_of, list(Z.SESSION)).select(F.col("number").alias("session"), "seq", *numbers("vector", len(VECTOR_SQL)))


@query("b17_health_bands", f"WITH {O.SES}, {O.LABELS}, g AS (SELECT station, 100 - 100.0::DOUBLE * count(first_fault_t) / count(*) AS x FROM lab GROUP BY ALL) SELECT station, CASE WHEN x >= 85 THEN 'healthy' WHEN x >= 70 THEN 'watch' WHEN x >= 50 THEN 'plan_service' ELSE 'urgent' END AS band FROM g")
def b17(s, d):
    g = labels(s, d).groupBy("station").agg((100 - 100.0 * F.count("first_fault_t") / F.count("*")).alias("x"))
    return g.select("station", S.health_band(F.col("x")).alias("band"))


@query("b13_reason_buckets", f"WITH {O.TRACK}, a AS (SELECT {O.SPEC} AS g, cablecheck_elapsed > 40 AS cable FROM trk) SELECT CASE WHEN g = 'PROTOCOL_FAILED' THEN 'baseline rule: ResponseCode' WHEN g = 'ISOLATION_FAULT' THEN 'baseline rule: isolation' WHEN g = 'EV_ERROR' THEN 'baseline rule: EV error' END AS bucket, count(*) AS n FROM a WHERE g IN ('PROTOCOL_FAILED', 'ISOLATION_FAULT', 'EV_ERROR') GROUP BY ALL")
def b13(s, d):
    rows = D.spec_rules(tracked(s, d)).where(F.col("alert.fault_guess").isin("PROTOCOL_FAILED", "ISOLATION_FAULT", "EV_ERROR"))
    return rows.groupBy(S.reason_bucket(F.col("alert.reason")).alias("bucket")).agg(F.count("*").alias("n"))


_LEARN = f"""og AS (SELECT {K3}, t_end - t_start AS x, graceful_close AND first_fault_t IS NULL AS healthy, row_number() OVER (PARTITION BY station, connector ORDER BY t_start, sid) AS k FROM lab),
es AS (SELECT DISTINCT station, connector, 0::BIGINT AS k, NULL::DOUBLE AS m, NULL::DOUBLE AS v FROM og UNION ALL
  SELECT es.station, es.connector, es.k + 1, CASE WHEN NOT healthy THEN m WHEN m IS NULL THEN x ELSE m + 0.25 * (x - m) END, CASE WHEN NOT healthy THEN v WHEN m IS NULL THEN 0 ELSE 0.75 * (v + 0.25 * (x - m) * (x - m)) END
  FROM es JOIN og ON es.station = og.station AND es.connector = og.connector AND og.k = es.k + 1)"""


@query("d13_station_baselines", f"WITH RECURSIVE {O.SES}, {O.LABELS}, {_LEARN} SELECT og.station, og.connector, og.sid, CAST(round(CASE WHEN og.k > 3 AND m IS NOT NULL THEN greatest(m + 3 * sqrt(v) + 0.25 * abs(m), 30) ELSE 60 END * 1e6) AS BIGINT) AS expected_us FROM og JOIN es ON es.station = og.station AND es.connector = og.connector AND es.k = og.k - 1")
def d13(s, d):
    table = labels(s, d).select(*Z.SESSION, "t_start", (F.col("t_end") - F.col("t_start")).alias("seconds"), (F.col("graceful_close") & F.col("first_fault_t").isNull()).alias("healthy"))
    return D.station_baselines(table, "seconds", default=60.0).select(*Z.SESSION, *micros("expected"))


@query("l5_station_counts", f"WITH {O.TEL}, b AS (SELECT station, kind, msg, resp_code, CAST(floor(t * 1e6) AS BIGINT) AS us FROM tel), w AS (SELECT *, unnest(range(0, 6)) AS i FROM b) SELECT station, (us // 10000000 - i) * 10 AS start_s, count(*) AS n, count(*) FILTER (msg = 'RETX') AS retx, count(*) FILTER (resp_code <> '') AS failed FROM w GROUP BY ALL")
def l5(s, d):
    out = live.station_counts(telemetry.fixture(s, d))
    return out.select("station", F.unix_seconds("start").alias("start_s"), "n", "retx", "failed")


@query("l2_session_windows", f"WITH {O.TEL}, a AS (SELECT station, connector, t, seq, CAST(floor(t * 1e6) AS BIGINT) AS us FROM tel WHERE kind IN ('v2g', 'tcp') OR regexp_matches(msg, 'SLAC|ATTEN_CHAR|VALIDATE')), b AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 60000000 THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY station, connector ORDER BY us, seq)), c AS (SELECT *, sum(n) OVER (PARTITION BY station, connector ORDER BY us, seq) AS g FROM b) SELECT station, connector, count(*) AS n_events, CAST(round(min(t) * 1e6) AS BIGINT) AS t_start_us, CAST(round(max(t) * 1e6) AS BIGINT) AS t_end_us FROM c GROUP BY station, connector, g")
def l2(s, d):
    return live.session_windows(telemetry.fixture(s, d)).select("station", "connector", "n_events", *micros("t_start", "t_end"))
