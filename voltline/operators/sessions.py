"""Sessions from event rows: window expressions over one shuffle by connector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

GAP_S = 60.0
JOIN_NEXT_S = 10.0
CONNECTOR = ("station", "connector")
SESSION = (*CONNECTOR, "sid")
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def per(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("t", "seq")


def last_before(value, *keys: str):
    return F.last(value, True).over(per(*keys).rowsBetween(*BEFORE))


def last_so_far(value, *keys: str):
    return F.last(value, True).over(per(*keys).rowsBetween(*UP_TO))


def count_so_far(flag, *keys: str):
    return F.sum(F.when(flag, 1).otherwise(0)).over(per(*keys).rowsBetween(*UP_TO))


def sessionize(events: DataFrame, gap_s: float = GAP_S, join_next_s: float = JOIN_NEXT_S, bucket_s: float | None = None) -> DataFrame:
    """``events`` with ``sid``, the session's number within its connector from 0.

    A session ends when activity rows are more than ``gap_s`` apart, or when a dialog opens after a stop
    within it. Quiet rows stay with activity at most ``gap_s`` before them; later ones wait for the next
    session, whose buffer keeps the newest and takes those at most ``join_next_s`` before it. The others
    belong to no session and go.

    Without ``bucket_s`` a connector's history is one window partition. With it, the history is cut into buckets of
    so many seconds, which are scanned in parallel and hand over a small state each (``_scanned_by_bucket``), so that a
    connector that holds most rows of the table uses many tasks; the result is the same.
    """
    rows = events.withColumn("_act", S.is_activity(F.col("kind"), F.col("msg")))
    rows = _scanned(rows, gap_s) if bucket_s is None else _scanned_by_bucket(rows, gap_s, bucket_s)
    # quiet rows that wait are counted from the activity before them and from the one after
    n = F.col("_next._w") - F.col("_w0")
    held = F.when(n <= 200, n).otherwise(100 + (n - 201) % 101)
    joins = ~F.col("_stays") & (F.col("_next._w") - F.col("_w") < held) & (F.col("_next.t") - F.col("t") <= join_next_s)
    rows = rows.withColumn("sid", F.when(F.col("_stays"), F.col("_sid")).when(joins, F.col("_sid") + 1).cast("int"))
    return rows.where("sid IS NOT NULL").select(*events.columns, "sid")


def _local(rows: DataFrame, gap_s: float, keys: tuple[str, ...], last_in: Column | None = None) -> DataFrame:
    """Running values within each window partition of ``keys``; ``last_in`` is the last activity before it.

    _new: begins a session; _maybe: does so if the marker before the partition is a stop; _left: the marker that a row leaves
    behind; _stays: belongs to the activity at or before it; _n, _u, _w: new, maybe and waiting rows so far; _w0: _w at the activity
    before; _next: time and _w of the next activity.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("seq"))  # a running frame backwards: one that looks ahead would be summed anew for every row
    opener = S.is_opener(F.col("kind"), F.col("msg"))
    last = last_before(F.when(F.col("_act"), F.col("t")), *keys)
    rows = rows.withColumn("_last", last if last_in is None else F.coalesce(last, last_in))
    rows = rows.withColumn("_gap", F.col("_act") & (F.col("_last").isNull() | (F.col("t") - F.col("_last") > gap_s)))
    # what a row leaves behind for the rows after it: its own marker, or none where a gap begins a new run
    left = F.when((F.col("kind") == "v2g") & F.col("msg").isin("SessionStopReq", "SessionStopRes"), "S").when(opener, "O").when(F.col("_gap"), "")
    rows = rows.withColumn("_left", left).withColumn("_seen", last_before(F.col("_left"), *keys))
    opens = opener & ~F.col("_gap")
    flags = {
        "_new": F.col("_gap") | F.coalesce(opens & (F.col("_seen") == "S"), F.lit(False)),
        "_maybe": opens & F.col("_seen").isNull(),
        "_stays": F.coalesce(F.col("_act") | (F.col("t") - F.col("_last") <= gap_s), F.lit(False)),
    }
    rows = rows.withColumns(flags)
    rows = rows.withColumns({"_n": count_so_far(F.col("_new"), *keys), "_u": count_so_far(F.col("_maybe"), *keys), "_w": count_so_far(~F.col("_stays"), *keys)})
    of_activity = {
        "_w0": last_before(F.when(F.col("_act"), F.col("_w")), *keys),
        "_next": F.last(F.when(F.col("_act"), F.struct("t", "_w")), True).over(back.rowsBetween(*BEFORE)),
    }
    return rows.withColumns(of_activity)


def _scanned(rows: DataFrame, gap_s: float) -> DataFrame:
    return _local(rows, gap_s, CONNECTOR).withColumns({"_sid": F.col("_n") - 1, "_w0": F.coalesce("_w0", F.lit(0))})


def _scanned_by_bucket(rows: DataFrame, gap_s: float, bucket_s: float) -> DataFrame:
    """What ``_scanned`` gives, by a scan in two levels.

    Level one reduces a bucket to its last activity, which tells the next buckets whether their first activity follows a gap. Level two
    reduces it to what else later rows need: sessions begun, the one opener whose begin depends on the marker before
    the bucket, the last marker, waiting rows, and the first and last activity. These states, a row a bucket, are combined in order of time by
    running windows and joined to the rows, which move once, by connector and bucket.
    """
    keys = (*CONNECTOR, "_b")
    order = Window.partitionBy(*CONNECTOR).orderBy("_b").rowsBetween(*BEFORE)
    back = Window.partitionBy(*CONNECTOR).orderBy(F.desc("_b")).rowsBetween(*BEFORE)
    rows = rows.withColumn("_b", F.floor(F.col("t") / bucket_s))
    ends = rows.groupBy(*keys).agg(F.max(F.when(F.col("_act"), F.col("t"))).alias("_end"))
    # the hints keep the rows dealt by connector and bucket, whichever side is small
    carried_in = ends.select(*keys, F.last("_end", True).over(order).alias("_in")).hint("shuffle_hash")
    rows = _local(rows.join(carried_in, list(keys)), gap_s, keys, F.col("_in"))

    place = lambda flag, value: F.when(flag, F.struct("t", "seq", value))
    states = rows.groupBy(*keys).agg(
        F.count_if("_new").alias("n"),
        F.count_if("_maybe").alias("u"),
        F.count_if(~F.col("_stays")).alias("w"),
        F.max(place(F.col("_left").isNotNull(), "_left")).alias("marker"),
        F.min(place(F.col("_act"), "_w")).alias("first"),
        F.max(place(F.col("_act"), "_w")).alias("last"),
    )
    zero = F.lit(0).cast("bigint")
    states = states.withColumns({"_stop_in": F.coalesce(F.last("marker._left", True).over(order) == "S", F.lit(False)), "_w_in": F.coalesce(F.sum("w").over(order), zero)})
    begun = F.col("n") + F.when(F.col("_stop_in"), F.col("u")).otherwise(0)
    carried = {
        "_n_in": F.coalesce(F.sum(begun).over(order), zero),
        "_w0_in": F.last(F.col("last._w") + F.col("_w_in"), True).over(order),
        "_next_in": F.last(F.when(F.col("first").isNotNull(), F.struct(F.col("first.t").alias("t"), (F.col("first._w") + F.col("_w_in")).alias("_w"))), True).over(back),
    }
    rows = rows.join(states.withColumns(carried).select(*keys, "_stop_in", "_w_in", *carried).hint("shuffle_hash"), list(keys))
    after = F.when(F.col("_next").isNotNull(), F.struct(F.col("_next.t").alias("t"), (F.col("_next._w") + F.col("_w_in")).alias("_w")))
    return rows.withColumns({
        "_sid": F.col("_n_in") + F.col("_n") + F.when(F.col("_stop_in"), F.col("_u")).otherwise(0) - 1,
        "_w0": F.coalesce(F.col("_w0") + F.col("_w_in"), F.col("_w0_in"), zero),
        "_w": F.col("_w") + F.col("_w_in"),
        "_next": F.coalesce(after, F.col("_next_in")),
    })


def session_key(station="station", connector="connector", sid="sid"):
    return F.format_string("%s__%s__%04d", F.col(station), F.col(connector), F.col(sid))


def drop_noise(sessions: DataFrame, least_matching: int = 3) -> DataFrame:
    """Rows of sessions that have dialog rows or at least three matching frames."""
    whole = Window.partitionBy(*SESSION)
    matching = (F.col("kind") == "hpav") & (F.col("msg").contains("SLAC") | F.col("msg").contains("ATTEN_CHAR"))
    v2g = F.max(F.when(F.col("kind") == "v2g", 1).otherwise(0)).over(whole)
    return sessions.withColumn("_v", v2g).withColumn("_m", F.sum(F.when(matching, 1).otherwise(0)).over(whole)).where((F.col("_v") == 1) | (F.col("_m") >= least_matching)).drop("_v", "_m")


def session_table(sessions: DataFrame) -> DataFrame:
    """One row per session: bounds, counts, delivery."""
    return sessions.groupBy(*SESSION).agg(
        F.min("t").alias("t_start"),
        F.max("t").alias("t_end"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("kind") == "v2g").alias("n_v2g"),
    )


def dedupe_ring_files(spans: DataFrame) -> DataFrame:
    """Files (station, connector, file, first, last, n_rows) that reach beyond every file before them.

    Order: first, then the longest reach, then the most rows. A dropped file reaches no further than a kept
    one, so the running maximum over all files is that over the kept ones.
    """
    order = Window.partitionBy(*CONNECTOR).orderBy("first", F.desc("last"), F.desc("n_rows"), "file").rowsBetween(*BEFORE)
    return spans.withColumn("_reach", F.max("last").over(order)).where("_reach IS NULL OR last > _reach").drop("_reach")


def data_cuts(spans: DataFrame, gap_s: float = GAP_S, large: int = 4_500_000) -> DataFrame:
    """(station, connector, cut): a file's end where the next begins more than ``gap_s`` later, if the file
    was full or the next does not begin with an opener; the last file's end always."""
    order = Window.partitionBy(*CONNECTOR).orderBy("first", "file")
    rows = spans.withColumn("_next", F.lead("first").over(order)).withColumn("_msg", F.lead("first_v2g").over(order))
    opens = F.coalesce(F.col("_msg").isin("supportedAppProtocolReq", "SessionSetupReq"), F.lit(False))
    cut = F.col("_next").isNull() | ((F.col("_next") - F.col("last") > gap_s) & ((F.col("size_bytes") >= large) | ~opens))
    return rows.where(cut).select(*CONNECTOR, F.col("last").alias("cut"))


def drop_truncation_artifacts(labels: DataFrame, cuts: DataFrame, near_s: float = 5.0) -> DataFrame:
    """Labels but those that a cut explains: clean and not graceful with the end near a cut, or nothing but
    SESSION_ABORT with a fault near a cut. ``labels`` has t_end, graceful, faults (t, family)."""
    only_abort = (F.size("faults") > 0) & F.forall("faults", lambda f: f.family == "SESSION_ABORT")
    suspects = labels.withColumn("_clean", (F.size("faults") == 0) & ~F.col("graceful")).withColumn("_abort", only_abort)
    c = cuts.select(*[F.col(k).alias(f"_{k}") for k in CONNECTOR], "cut")
    same = (F.col("station") == F.col("_station")) & (F.col("connector") == F.col("_connector"))
    near = (F.col("_clean") & (F.abs(F.col("t_end") - F.col("cut")) <= near_s)) | (F.col("_abort") & F.exists("faults", lambda f: F.abs(f.t - F.col("cut")) <= near_s))
    return suspects.join(c, same & near, "left_anti").drop("_clean", "_abort")


def collapse_clones(contents: DataFrame, buckets: int = 1024) -> DataFrame:
    """(station, canonical): stations with the same set of (station, file, sha256) contents share the first name.

    Files are hashed by bucket of their names first, so a list holds a bucket of a station's files, or a station's buckets.
    """
    entry = F.concat_ws(":", "file", "sha256")
    signed = lambda df, x, *keys: df.groupBy(*keys).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(x))), 256).alias("signature"))
    parts = signed(contents.withColumn("_b", F.pmod(F.xxhash64("file"), F.lit(buckets))), entry, "station", "_b")
    whole = signed(parts, F.concat_ws(":", "_b", "signature"), "station")
    return whole.select("station", F.min("station").over(Window.partitionBy("signature")).alias("canonical"))


def complete_only(stations: DataFrame, files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Stations none of whose files lack an output."""
    missing = files.join(outputs, ["station", "file"], "left_anti").select("station").distinct()
    return stations.join(missing, "station", "left_anti")
