"""Queries over files and tables that the library writes: ring files, captures, the bucketed session store, the matrix, and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import sessions as Z
from ..operators import table_functions as TF
from ..operators import training as T
from ..sources import frames, telemetry
from . import oracle_base as O
from .feature_queries import micros, query, sessions, smoothed, us
from .label_queries import K3, everything
from .tables import scratch, stored

SLOT_S = 1800.0
BUCKETS = 16


@query("a4_variant_fields", f"WITH {O.TEL} SELECT seq, CASE WHEN seq % 10 <> 0 THEN k END AS k, CASE WHEN seq % 10 <> 0 THEN source END AS source, CAST(NULL AS VARCHAR) AS missing FROM tel")
def a4_variant(s, d):
    """Keys of ``extra`` with their types; every tenth object is cut short and gives nulls."""
    rows = telemetry.fixture(s, d)
    extra = F.when(F.col("seq") % 10 == 0, F.expr("left(extra, length(extra) - 1)")).otherwise(F.col("extra"))
    return rows.select("seq", *[c.alias(n) for n, c in S.extra_fields(extra, k="int", source="string", missing="string").items()])


@query("a6_session_store", f"WITH {O.PH} SELECT seq, phase, {us('phase_elapsed', 'session_elapsed')} FROM ph")
def a6_store(s, d):
    """Phases over the bucketed store, whose windows by session need no shuffle."""
    return X.phases(frames.session_store(sessions(s, d), scratch(s, "session-store"), BUCKETS)).select("seq", "phase", *micros("phase_elapsed", "session_elapsed"))


_RING = f"""rf AS (SELECT 0 AS copy, * FROM tel UNION ALL SELECT 1, * FROM tel WHERE t - floor(t / {SLOT_S:.0f}) * {SLOT_S:.0f} < {SLOT_S / 2:.0f}),
rs AS (SELECT station, connector, CAST(floor(t / {SLOT_S:.0f}) AS BIGINT) AS slot, copy, min(t) AS first, max(t) AS last, count(*) AS n_rows, arg_min(msg, seq) FILTER (kind = 'v2g') AS first_v2g FROM rf GROUP BY ALL)"""


def ring_spans(s, d):
    """Spans of ring files that were fetched twice: whole, and when they were half full."""
    path, rows = scratch(s, "rings"), telemetry.fixture(s, d)
    frames.write_ring_files(rows, path, SLOT_S)
    frames.write_ring_files(rows.where(F.col("t") - F.floor(F.col("t") / SLOT_S) * SLOT_S < SLOT_S / 2), path, SLOT_S, 1)
    return frames.file_spans(frames.read_ring_files(s, path, rows.schema))


@query("a7_ring_files", f"WITH {O.TEL}, {_RING} SELECT station, connector, slot, copy, {us('first', 'last')}, n_rows, first_v2g, true AS sized FROM rs")
def a7_files(s, d):
    return ring_spans(s, d).select(*Z.CONNECTOR, "slot", "copy", *micros("first", "last"), "n_rows", "first_v2g", (F.col("size_bytes") > 0).alias("sized"))


@query("s5_ring_files", f"WITH {O.TEL}, {_RING}, rr AS (SELECT *, max(last) OVER (PARTITION BY station, connector ORDER BY first, last DESC, n_rows DESC, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rs) SELECT station, connector, slot, copy, n_rows FROM rr WHERE reach IS NULL OR last > reach")
def s5_files(s, d):
    return Z.dedupe_ring_files(ring_spans(s, d)).select(*Z.CONNECTOR, "slot", "copy", "n_rows")


_MAGIC = list(frames.MAGIC_FORMATS)
_CAPTURE = f"""cp AS (SELECT doc_id // 50 AS capture, unhex(CASE doc_id // 50 % {len(_MAGIC) + 1} {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MAGIC))} ELSE '' END) AS magic, text, doc_id FROM documents),
cb AS (SELECT capture, unhex(hex(any_value(magic)) || string_agg(hex(encode(coalesce(text, ''))) || '0A', '' ORDER BY doc_id)) AS body FROM cp GROUP BY ALL)"""


@query("a8_capture_scan", f"WITH {_CAPTURE} SELECT capture, octet_length(body) AS size, CASE capture % {len(_MAGIC) + 1} {' '.join(f'WHEN {i} THEN {chr(39)}{f}{chr(39)}' for i, f in enumerate(frames.MAGIC_FORMATS.values()))} END AS format, sha256(body) AS sha256, capture % {len(_MAGIC) + 1} < {len(_MAGIC)} AND octet_length(body) >= {frames.LEAST_HEADER} AS valid FROM cb")
def a8(s, d):
    """Fifty documents make a file, behind the magic number of a format or none; the scan reads size, format and hash from the bytes."""
    path, kind = scratch(s, "captures"), F.col("capture") % (len(_MAGIC) + 1)
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("doc_id DIV 50").alias("capture"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    first = F.col("doc_id") == F.min("doc_id").over(Z.Window.partitionBy("capture"))
    magic = F.lit(b"")
    for i, m in enumerate(_MAGIC):
        magic = F.when(kind == i, F.lit(bytes.fromhex(m))).otherwise(magic)
    lines = docs.withColumn("value", F.when(first, F.concat(magic, F.col("body"))).otherwise(F.col("body")).cast("string"))
    lines.repartition("capture").sortWithinPartitions("capture", "doc_id").select("value", "capture").write.partitionBy("capture").text(path)
    found = frames.scan_captures(s, path)
    return found.select(F.regexp_extract("path", "capture=([0-9]+)/", 1).cast("bigint").alias("capture"), "size", "format", "sha256", "valid")


@query("a9_numbered_matrix", f"WITH {O.TRACK} SELECT CASE WHEN CAST(substr(station, 3) AS INT) % 2 = 0 THEN 'train' ELSE 'test' END AS split, dense_rank() OVER (ORDER BY station, connector, sid) - 1 AS number, {K3}, seq, count(*) OVER (PARTITION BY {K3}) AS n_steps, 33 AS width FROM trk")
def a9_matrix(s, d):
    """The matrix and its sessions, written by split and read back; numbers run over all sessions in order of their keys."""
    rows, path = stored(X.feature_vector(smoothed(s, d)), "steps"), scratch(s, "matrix")
    numbers = T.globally_numbered(rows.select(*Z.SESSION).distinct(), stored, least_rows=1000)
    even = F.substring("station", 3, 10).cast("int") % 2 == 0
    T.write_matrix(rows, numbers, rows.select("station").distinct().withColumn("split", F.when(even, "train").otherwise("test")), path)
    steps, meta = s.read.parquet(f"{path}/steps"), s.read.parquet(f"{path}/sessions")
    return steps.join(meta, ["split", "number"]).select("split", "number", *Z.SESSION, "seq", "n_steps", F.size("vector").alias("width"))


@query("u1_detectors_in_sql", f"WITH {O.SCORED} SELECT detector, {K3}, CAST(round(t * 1e6) AS BIGINT) AS t_us, guess AS fault_guess FROM al")
def u1(s, d):
    """First alerts through ``spark.sql`` and a table function over rows partitioned by session."""
    views = TF.register(s, stored(everything(s, d), "features"), "Spec", "Conformance")
    calls = [f"SELECT '{name}' AS detector, station, connector, sid, CAST(round(t * 1e6) AS BIGINT) AS t_us, fault_guess FROM first_alert(TABLE({view}) PARTITION BY (station, connector, sid) ORDER BY (t, seq))" for name, view in views.items()]
    return s.sql(" UNION ALL ".join(calls))
