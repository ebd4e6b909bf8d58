"""Training sets: holdout by site, step labels, bounded deterministic samples, windows, transitions, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .sessions import SESSION, per

HORIZON_S = 60.0
HASH_BITS, RANGE_BITS = 60, 16


def hash_order(*columns: str, seed: int = 42):
    """A deterministic order that stands for a shuffle: the first HASH_BITS of the MD5 of the columns as text, which any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def station_holdout(stations: DataFrame, share: float = 0.2, seed: int = 42, inherited: DataFrame | None = None) -> DataFrame:
    """(station, site, group, split): whole sites go to test, in hash order, until a group's stations reach its share.

    ``inherited`` (station) are test stations of an earlier split: their sites come first and always stay in test. An
    inherited station that is missing is an error. A site lies in one split only, whatever groups its stations have.
    """
    s = stations.select("station").distinct().withColumn("site", S.site_of(F.col("station"))).withColumn("group", S.station_group(F.col("station")))
    if inherited is None:
        inherited = s.where("false").select("station")
    old = inherited.select("station").distinct().join(s, "station", "left")
    old = old.select("site", F.assert_true(F.col("site").isNotNull(), F.concat(F.lit("inherited station is missing: "), "station")).alias("_ok")).where("_ok IS NULL").select("site").distinct().withColumn("_old", F.lit(True))
    sites = s.groupBy("group", "site").agg(F.count("*").alias("n")).join(old, "site", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    order = Window.partitionBy("group").orderBy(F.desc("_old"), hash_order("site", seed=seed), "site")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = F.ceil(share * F.sum("n").over(Window.partitionBy("group")))
    chosen = sites.withColumn("split", F.when(F.col("_old") | (before < want), "test").otherwise("train"))
    # a site that is held out in one group is held out in all
    chosen = chosen.groupBy("site").agg(F.min("split").alias("split"))
    return s.join(chosen, "site").select("station", "site", "group", "split")


def leaked_sites(split: DataFrame) -> DataFrame:
    """Sites whose stations lie in more than one split; none is expected."""
    return split.groupBy("site").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def step_labels(rows: DataFrame, labels: DataFrame, horizon_s: float = HORIZON_S) -> DataFrame:
    """``rows`` with y = 1 from ``horizon_s`` before the first fault on."""
    j = rows.join(labels.select(*SESSION, "first_fault_t"), list(SESSION))
    return j.withColumn("y", F.when(F.col("first_fault_t") - F.col("t") <= horizon_s, 1).otherwise(0))


RANGES = 1 << RANGE_BITS


def least_by_hash(rows: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows of ``rows`` with the least hash of ``keys``: a uniform, deterministic choice, which no task sorts or holds whole.

    Rows are counted by RANGES ranges of the hash. Ranges below the one that holds the n-th hash are taken whole; only
    that range's rows are ranked.
    """
    h = hash_order(*keys, seed=seed)
    rows = rows.withColumn("_h", h).withColumn("_r", F.shiftright("_h", HASH_BITS - RANGE_BITS))
    ranges = rows.groupBy("_r").agg(F.count("*").alias("_c"))
    ranges = ranges.withColumn("_before", F.sum("_c").over(Window.orderBy("_r")) - F.col("_c"))  # at most RANGES rows
    room = ranges.where(F.col("_before") < n).select("_r", (F.lit(n) - F.col("_before")).alias("_room"), "_c")
    kept = rows.join(F.broadcast(room), "_r")  # at most RANGES rows
    edge = kept.where("_room < _c").withColumn("_n", F.row_number().over(Window.partitionBy("_r").orderBy("_h", *keys))).where("_n <= _room").drop("_n")
    return kept.where("_room >= _c").unionByName(edge).drop("_h", "_r", "_room", "_c")


def subsample_negatives(rows: DataFrame, ratio: int = 8, least: int = 1000, cap: int = 400_000, seed: int = 42) -> DataFrame:
    """All positives and at most ratio x max(positives, least) negatives, no more than ``cap``, those of the least hash.

    The number of positives is a row of the plan, not an action: the threshold is found from counts of hash ranges.
    """
    h = hash_order(*SESSION, "seq", seed=seed)
    rows = rows.withColumn("_h", h).withColumn("_r", F.shiftright("_h", HASH_BITS - RANGE_BITS))
    negatives = rows.where("y = 0")
    keep = rows.agg(F.least(F.lit(cap), ratio * F.greatest(F.count_if(F.col("y") == 1), F.lit(least))).alias("_keep"))
    ranges = negatives.groupBy("_r").agg(F.count("*").alias("_c"))
    ranges = ranges.withColumn("_before", F.sum("_c").over(Window.orderBy("_r")) - F.col("_c")).crossJoin(F.broadcast(keep))  # at most RANGES rows, and one
    room = ranges.where("_before < _keep").select("_r", (F.col("_keep") - F.col("_before")).alias("_room"), "_c")
    kept = negatives.join(F.broadcast(room), "_r")
    edge = kept.where("_room < _c").withColumn("_n", F.row_number().over(Window.partitionBy("_r").orderBy("_h", *SESSION, "seq"))).where("_n <= _room").drop("_n")
    out = kept.where("_room >= _c").unionByName(edge).drop("_room", "_c")
    return rows.where("y = 1").unionByName(out).drop("_h", "_r")


def session_threshold(scores: DataFrame, labels: DataFrame, quantile: float = 0.95) -> DataFrame:
    """The quantile, linear between neighbours, over clean sessions of their greatest score; by counting, without gathering the scores."""
    from .scoring import order_statistics

    clean = scores.join(labels.where("first_fault_t IS NULL").select(*SESSION), list(SESSION), "left_semi")
    most = clean.groupBy(*SESSION).agg(F.max("score").alias("score")).withColumn("_all", F.lit(1))
    at = (F.col("n") - 1) * F.lit(quantile)
    two = order_statistics(most, "score", {"lo": F.floor(at), "hi": F.ceil(at)}, "_all")
    place = most.where("score IS NOT NULL").groupBy("_all").agg(((F.count("*") - 1) * F.lit(quantile)).alias("_at"))
    part = F.col("_at") - F.floor("_at")
    return two.join(place, "_all").select((F.col("lo") * (1 - part) + F.col("hi") * part).alias("threshold"))


def sliding_windows(rows: DataFrame, value: str, length: int = 32, stride: int = 8) -> DataFrame:
    """(session, start, window): full windows of ``length`` readings every ``stride`` rows, inside a session."""
    order = per(*SESSION)
    w = rows.withColumn("_n", F.row_number().over(order) - 1).withColumn("window", F.collect_list(value).over(order.rowsBetween(0, length - 1)))
    return w.where((F.size("window") == length) & (F.col("_n") % stride == 0)).select(*SESSION, F.col("_n").alias("start"), "window")


def capped(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """A uniform, deterministic choice of at most ``n`` rows."""
    return least_by_hash(df, n, *keys, seed=seed)


def state_stack(rows: DataFrame, value: str, depth: int = 4) -> DataFrame:
    """``stack``: the last ``depth`` values, the session's first repeated before its start."""
    order = per(*SESSION)
    first = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stack", F.array(*[F.coalesce(F.lag(value, k).over(order), first) if k else F.col(value) for k in range(depth - 1, -1, -1)]))


def transitions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """alert_reward, wait_reward and done for each step of a session."""
    j = rows.join(labels.select(*SESSION, "first_fault_t"), list(SESSION))
    lead = F.greatest(F.col("first_fault_t") - F.col("t"), F.lit(0.0))
    alert = F.when(F.col("first_fault_t").isNull(), -1.5).when(F.col("t") <= F.col("first_fault_t") + 10, 1 + F.least(lead, F.lit(120.0)) / 120).otherwise(0.2)
    last = F.lead("t").over(per(*SESSION)).isNull()
    wait = F.when(last, F.when(F.col("first_fault_t").isNull(), 0.3).otherwise(-1.0)).otherwise(0.0)
    return j.withColumn("alert_reward", alert).withColumn("wait_reward", wait).withColumn("done", last)


def patch_labels(features: DataFrame, labels: DataFrame, moved_s: float = 0.5) -> DataFrame:
    """Counts of sessions whose labels changed under existing features (session, old_t): flipped, re-anchored, missing."""
    key = list(SESSION)
    j = features.select(*key, "old_t").distinct().join(labels.select(*key, F.col("first_fault_t").alias("new_t"), F.lit(True).alias("found")), key, "left")
    a, b, known = F.col("old_t"), F.col("new_t"), F.coalesce("found", F.lit(False))
    return j.agg(F.count("*").alias("sessions"), F.count_if(known & (a.isNull() != b.isNull())).alias("flipped"), F.count_if(known & (F.abs(a - b) > moved_s)).alias("reanchored"), F.count_if(~known).alias("missing"))


def clean_sample(labels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All faulty sessions and ``n`` clean ones in hash order."""
    clean = least_by_hash(labels.where("first_fault_t IS NULL"), n, *SESSION, seed=seed)
    return labels.where("first_fault_t IS NOT NULL").unionByName(clean)


def stage_split(sessions: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """The rows of one split's stations."""
    return sessions.join(split.where(F.col("split") == name).select("station"), "station", "left_semi")


def missing_from(staged: DataFrame, labels: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Labelled sessions of the split that ``staged`` does not have; none is expected."""
    wanted = labels.join(split.where(F.col("split") == name).select("station"), "station", "left_semi").select(*SESSION)
    return wanted.join(staged.select(*SESSION).distinct(), list(SESSION), "left_anti")


def window_samples(windows: DataFrame, n: int, *keys: str, source: str = "station", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A uniform choice of at most ``n`` windows over all sources, and (source, windows, kept): where they come from."""
    kept = least_by_hash(windows, n, *keys, seed=seed)
    seen = windows.groupBy(source).agg(F.count("*").alias("windows"))
    return kept, seen.join(kept.groupBy(source).agg(F.count("*").alias("kept")), source, "left").fillna(0, ["kept"])


def select_split(index: DataFrame, split: DataFrame, wanted: str) -> DataFrame:
    """Sessions of ``index`` by what is asked for: "all", a split's name, a group's name, or station name parts with commas between."""
    if wanted == "all":
        return index
    if wanted in ("test", "train"):
        return stage_split(index, split, wanted)
    if wanted in ("main", "v2g2024", "v2g2025"):
        return index.where(S.station_group(F.col("station")) == wanted)
    parts = F.array(*[F.lit(p.strip()) for p in wanted.split(",") if p.strip()])
    return index.where(F.exists(parts, lambda p: F.col("station").contains(p)))


def globally_numbered(keys: DataFrame, store, least_rows: int = 1 << 20) -> DataFrame:
    """``keys`` (distinct rows) with ``number``, their place from 0 in the order of all columns over the whole table.

    Rows are dealt by range and numbered within their range; a range's offset is the count of the ranges before it, so no task sees
    more than a range of about ``least_rows`` rows. ``store`` (DataFrame, label) writes a table and reads it: ranges depend on a
    sample and must not be drawn twice.
    """
    columns = keys.columns
    keys = store(keys, "keys")
    ranges = max(1, -(-keys.count() // least_rows))
    dealt = store(keys.repartitionByRange(ranges, *columns).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before"))
    within = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*columns)))
    return within.join(F.broadcast(offsets), "_range").select(*columns, (F.col("_before") + F.col("_k") - 1).alias("number"))


def write_matrix(rows: DataFrame, numbers: DataFrame, split: DataFrame, path: str) -> None:
    """The feature matrix and the sessions' meta data by split under ``path``: ``steps`` (number, seq, vector) and ``sessions``
    (number, session, t_start, t_end, n_steps). ``numbers`` comes from ``globally_numbered``, ``split`` is (station, split)."""
    placed = rows.join(numbers, list(SESSION)).join(split, "station")
    placed.select("split", "number", "seq", "vector").write.mode("overwrite").partitionBy("split").parquet(f"{path}/steps")
    meta = placed.groupBy("split", "number", *SESSION).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_steps"))
    meta.write.mode("overwrite").partitionBy("split").parquet(f"{path}/sessions")
