"""Scoring of detectors against labels, rollups by family, connector and station, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .sessions import SESSION

LEAD_CAP_S, GRACE_S, TIE_S = 120.0, 10.0, 0.1


def outcomes(labels: DataFrame, alerts: DataFrame, detectors: DataFrame) -> DataFrame:
    """One row per session and detector: outcome (tp, late, miss, fp, quiet), lead (seconds before the fault, on time only).

    ``labels`` has first_fault_t (null: clean); ``detectors`` is the list of names, from the registry, so a few rows.
    """
    pairs = labels.crossJoin(F.broadcast(detectors.select("detector")))
    a = alerts.select(*SESSION, "detector", F.col("t").alias("alert_t"), *[c for c in ("confidence", "reason", "fault_guess") if c in alerts.columns])
    return judged(pairs.join(a, [*SESSION, "detector"], "left"))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (first_fault_t, alert_t) with outcome and lead."""
    faulty, silent = F.col("first_fault_t").isNotNull(), F.col("alert_t").isNull()
    on_time = F.col("alert_t") <= F.col("first_fault_t") + GRACE_S
    outcome = F.when(faulty, F.when(silent, "miss").when(on_time, "tp").otherwise("late")).otherwise(F.when(silent, "quiet").otherwise("fp"))
    return rows.withColumn("outcome", outcome).withColumn("lead", F.when(faulty & on_time, F.greatest(F.lit(0.0), F.col("first_fault_t") - F.col("alert_t"))))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def order_statistics(rows: DataFrame, value: str, places: dict[str, Column], *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, one column per place): the values at the given indexes, from 0, of each group's sorted ``value``.

    A place is a column over ``n``, the number of non-null values. Nothing is gathered: values are counted, their
    counts by range of a 64th of an octave say which range holds an index, and only the distinct values of that range
    are ranked. Values are not negative; groups without values have no row. ``weight`` names how often a row counts.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    counts = rows.where(x.isNotNull()).groupBy(*keys, x.alias("_x")).agg((F.sum(weight) if weight else F.count("*")).alias("_c")).withColumn("_b", F.floor(F.log2(F.col("_x") + 1e-9) * 64))
    ranges = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    run = Window.partitionBy(*keys).orderBy("_b")
    ranges = ranges.withColumn("_upto", F.sum("_c").over(run)).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("bigint").alias("at")) for name, place in places.items()]))
    hit = ranges.select(*keys, "_b", "_upto", "_c", wanted.alias("_w")).where((F.col("_w.at") < F.col("_upto")) & (F.col("_w.at") >= F.col("_upto") - F.col("_c")))
    hit = hit.select(*keys, "_b", F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_upto") + F.col("_c")).alias("_at"))
    inner = counts.join(hit, [*keys, "_b"]).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_x"))).where("_at < _n AND _at >= _n - _c")
    return inner.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in places])


def scored(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts, recall, far, earliness, score, leads for each group of ``keys``, which are not null.

    Outcomes are first counted by what the scores read, so counts and the upper median of the leads share one pass.
    """
    faulty = F.col("first_fault_t").isNotNull()
    base = outcomes.groupBy(*keys, "outcome", faulty.alias("_faulty"), F.col("lead").alias("_lead")).agg(F.count("*").alias("_c"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_c"))), F.lit(0))
    has, lead = F.col("_lead").isNotNull(), F.col("_lead") * F.col("_c")
    out = base.groupBy(*keys).agg(
        F.sum("_c").alias("sessions"), n(F.col("_faulty")).alias("n_faulty"), n(~F.col("_faulty")).alias("n_clean"), *[n(F.col("outcome") == o).alias(o) for o in ("tp", "late", "miss", "fp", "quiet")],
        F.coalesce(F.sum(F.least("_lead", F.lit(LEAD_CAP_S)) / LEAD_CAP_S * F.col("_c")), F.lit(0.0)).alias("_early"), share(F.sum(lead), n(has)).alias("mean_lead"),
    )
    median = order_statistics(base, "_lead", {"median_lead": F.floor(F.col("n") / 2)}, *keys, weight="_c")
    out = out.join(median, list(keys), "left").withColumn("median_lead", F.coalesce("median_lead", F.lit(0.0)))
    out = out.withColumns({"recall": share(F.col("tp"), F.col("n_faulty")), "far": share(F.col("fp"), F.col("n_clean")), "earliness": share(F.col("_early"), F.col("n_faulty"))})
    out = out.withColumns({"score": 50 * F.col("recall") + 30 * (1 - F.col("far")) + 20 * F.col("earliness"), "precision": share(F.col("tp"), F.col("tp") + F.col("fp"))})
    return out.withColumns({"f1": share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "fault_rate": share(100 * F.col("n_faulty"), F.col("sessions"))}).drop("_early")


def recall_by_family(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.where("first_fault_t IS NOT NULL").groupBy("detector", F.col("first_fault_family").alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "tp").alias("tp"))
    return rows.withColumn("recall", share(F.col("tp"), F.col("n")))


def wins(outcomes: DataFrame) -> DataFrame:
    """(detector, wins): the earliest on-time detector of a session, ties within a tenth of a second sharing it."""
    whole = Window.partitionBy(*SESSION)
    best = outcomes.where("outcome = 'tp'").withColumn("_b", F.min("alert_t").over(whole)).where(F.col("alert_t") - F.col("_b") <= TIE_S)
    return best.withColumn("_n", F.count("*").over(whole)).groupBy("detector").agg(F.sum(1.0 / F.col("_n")).alias("wins"))


def top_family(outcomes: DataFrame, *keys: str) -> DataFrame:
    """The most frequent first-fault family of each group; of equals the first by name."""
    counts = outcomes.where("first_fault_family IS NOT NULL").groupBy(*keys, "first_fault_family").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("first_fault_family", F.struct(-F.col("n"), "first_fault_family")).alias("top_family"))


def station_rollup(outcomes: DataFrame) -> DataFrame:
    """Scores by station and detector, with the top family."""
    return scored(outcomes, "station", "detector").join(top_family(outcomes, "station", "detector"), ["station", "detector"], "left")


def levels(outcomes: DataFrame) -> DataFrame:
    """Sessions and fault counts by station, by connector and by family, in one pass of grouping sets."""
    outcomes = outcomes.withColumn("family", F.coalesce("first_fault_family", F.lit("none")))
    sets = outcomes.groupingSets([["station"], ["station", "connector"], ["station", "family"]], "station", "connector", "family")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("sessions"), F.count_if(F.col("first_fault_t").isNotNull()).alias("n_faulty"), F.count_if(F.col("outcome") == "tp").alias("tp"))


def top_evidence(faults: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent details of each (station, family): count descending, text ascending."""
    counts = faults.groupBy("station", "family", "detail").agg(F.count("*").alias("n"))
    order = Window.partitionBy("station", "family").orderBy(F.desc("n"), "detail")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def ranked(board: DataFrame) -> DataFrame:
    """A leaderboard with rank: score descending, name ascending. Its rows are detectors, so one partition holds them."""
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "detector")))


def violations(board: DataFrame, by_family: DataFrame, by_station: DataFrame) -> DataFrame:
    """(detector, rule) wherever parts do not add up to their totals; none is expected."""
    fam = by_family.groupBy("detector").agg(F.sum("n").alias("f_n"), F.sum("tp").alias("f_tp"))
    sta = by_station.groupBy("detector").agg(*[F.sum(c).alias(f"s_{c}") for c in ("sessions", "n_faulty", "tp", "late", "miss", "fp", "quiet")])
    j = board.join(fam, "detector", "left").join(sta, "detector", "left")
    checks = {
        "outcomes of faulty sessions": F.col("tp") + F.col("late") + F.col("miss") == F.col("n_faulty"),
        "outcomes of clean sessions": F.col("fp") + F.col("quiet") == F.col("n_clean"),
        "recall": F.abs(F.col("recall") - share(F.col("tp"), F.col("n_faulty"))) < 1e-9,
        "families": (F.coalesce("f_n", F.lit(0)) == F.col("n_faulty")) & (F.coalesce("f_tp", F.lit(0)) == F.col("tp")),
        "stations": (F.col("s_sessions") == F.col("sessions")) & (F.col("s_tp") == F.col("tp")) & (F.col("s_fp") == F.col("fp")) & (F.col("s_miss") == F.col("miss")),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    return j.select("detector", F.explode(broken).alias("rule"))


# fixed values: weight of each family for a station's health
FAMILY_WEIGHT = {"EVSE_FAULT": 1.0, "ISOLATION_FAULT": 1.0, "NO_POWER_DELIVERED": 0.9, "COMM_FREEZE": 0.85, "SESSION_ABORT": 0.75, "PROTOCOL_FAILED": 0.65, "SLAC_FAILURE": 0.55, "EV_ERROR": 0.35}
OTHER_WEIGHT = 0.65


def station_health(labels: DataFrame) -> DataFrame:
    """score, band, confidence, parts and reason codes by station from labels (station, connector, first_fault_family)."""
    from ..functions.constants import lookup

    clamp = lambda x: F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0))
    faulty = F.col("first_fault_family").isNotNull()
    rate = lambda: share(100 * F.count_if(faulty), F.count("*"))
    by_connector = labels.groupBy("station", "connector").agg(F.count("*").alias("n"), rate().alias("rate"))
    connectors = by_connector.groupBy("station").agg(F.max(F.when(F.col("n") >= 20, F.col("rate"))).alias("worst"), F.avg(clamp(F.col("n") / 50 * 100)).alias("coverage"))
    weight = lookup(FAMILY_WEIGHT, F.col("first_fault_family"), OTHER_WEIGHT)
    whole = labels.groupBy("station").agg(F.count("*").alias("sessions"), rate().alias("rate"), (100 * F.sum(F.when(faulty, weight).otherwise(0.0)) / F.count("*")).alias("weighted"))
    j = whole.join(connectors, "station")
    excess = F.greatest(F.lit(0.0), F.coalesce("worst", "rate") - F.col("rate"))
    j = j.withColumn("reliability", clamp(100 - 2 * F.col("rate"))).withColumn("severity", clamp(100 - 2.5 * F.col("weighted"))).withColumn("excess", excess).withColumn("balance", clamp(100 - 2 * F.col("excess")))
    j = j.withColumn("score", F.round(0.55 * F.col("reliability") + 0.3 * F.col("severity") + 0.15 * F.col("balance"), 1))
    j = j.withColumn("confidence", F.round(0.75 * clamp(F.col("sessions") / 200 * 100) + 0.25 * F.col("coverage"), 1)).withColumn("band", S.health_band(F.col("score")))
    reasons = F.array_compact(F.array(
        F.when(F.col("rate") >= 20, "high_fault_rate").when(F.col("rate") >= 10, "elevated_fault_rate").otherwise("stable_fault_rate"),
        F.when(F.col("worst").isNotNull() & (F.col("excess") >= 10), "connector_hotspot"),
        F.when(F.col("confidence") < 50, "limited_sample"),
    ))
    return j.withColumn("reasons", reasons)


def natural_order(name: str = "station") -> list[Column]:
    """Order by the text before a name's number, then the number."""
    return [F.regexp_replace(name, r"\d+.*$", ""), F.regexp_extract(name, r"(\d+)", 1).cast("bigint"), F.col(name)]


def connector_skew(labels: DataFrame, least: int = 30) -> DataFrame:
    """Stations whose connectors both have enough sessions and differ by five points, the worse at five per cent or more."""
    by = labels.groupBy("station", "connector").agg(F.count("*").alias("n"), share(100 * F.count_if(F.col("first_fault_t").isNotNull()), F.count("*")).alias("rate"))
    wide = by.groupBy("station").pivot("connector", ["connector1", "connector2"]).agg(F.first("n").alias("n"), F.first("rate").alias("rate"))
    worse, better = F.greatest("connector1_rate", "connector2_rate"), F.least("connector1_rate", "connector2_rate")
    return wide.where((F.col("connector1_n") >= least) & (F.col("connector2_n") >= least) & (worse >= 5) & (worse - better >= 5)).select("station", "connector1_rate", "connector2_rate")


def attribution(outcomes: DataFrame) -> DataFrame:
    """Alerts by detector, group of reasons and outcome."""
    return outcomes.where("alert_t IS NOT NULL").groupBy("detector", S.reason_bucket(F.col("reason")).alias("bucket")).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "late", "fp")])


def arms(boards: DataFrame, reference: str) -> DataFrame:
    """Leaderboards of several arms (arm, detector, sessions, recall, far, score) as differences from the reference arm; raises if populations differ."""
    base = boards.where(F.col("arm") == reference).select("detector", F.col("sessions").alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("score", "recall", "far")])
    same = F.assert_true(F.col("sessions") == F.col("_n"), F.lit("the arms did not score the same sessions"))
    j = boards.join(base, "detector").where(same.isNull())
    return j.select("arm", "detector", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in ("score", "recall", "far")])


def run_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions of two runs by (station, connector, start): common, relabelled, only_old, only_new. Each has families (sorted array)."""
    key = ["station", "connector", "start"]
    o, n = old.select(*key, F.col("families").alias("fo")), new.select(*key, F.col("families").alias("fn"))
    kind = F.when(F.col("fn").isNull(), "only_old").when(F.col("fo").isNull(), "only_new").when(F.col("fo") == F.col("fn"), "common").otherwise("relabelled")
    return o.join(n, key, "full").select(*key, kind.alias("change"))


def flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Outcomes of one run against another on the sessions that both have, by detector."""
    key = [*SESSION, "detector"]
    j = old.select(*key, F.col("outcome").alias("a")).join(new.select(*key, F.col("outcome").alias("b")), key)
    kind = F.when((F.col("a") == "tp") & (F.col("b") == "tp"), "kept").when(F.col("b") == "tp", "gained").when(F.col("a") == "tp", "lost").when((F.col("a") == "fp") & (F.col("b") == "quiet"), "fixed_fp").when((F.col("a") == "quiet") & (F.col("b") == "fp"), "new_fp").when(F.col("a") == "quiet", "quiet").otherwise("other")
    return j.groupBy("detector", kind.alias("flip")).agg(F.count("*").alias("n"))


def transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """How labels move between two profiles: (from, to, n)."""
    state = lambda c: F.when(F.col(f"{c}_t").isNull(), "clean").otherwise(F.col(f"{c}_f"))
    o = old.select(*SESSION, F.col("first_fault_t").alias("o_t"), F.col("first_fault_family").alias("o_f"))
    n = new.select(*SESSION, F.col("first_fault_t").alias("n_t"), F.col("first_fault_family").alias("n_f"))
    return o.join(n, list(SESSION)).groupBy(state("o").alias("before"), state("n").alias("after")).agg(F.count("*").alias("n"))


def anchor_moves(old: DataFrame, new: DataFrame, moved_s: float = 0.5) -> DataFrame:
    """(family, n, moved, mean_s, least_s, most_s): how first faults of one family move in time between two profiles."""
    o = old.where("first_fault_t IS NOT NULL").select(*SESSION, F.col("first_fault_t").alias("a"), F.col("first_fault_family").alias("family"))
    n = new.where("first_fault_t IS NOT NULL").select(*SESSION, F.col("first_fault_t").alias("b"), F.col("first_fault_family").alias("family"))
    d = F.col("b") - F.col("a")
    j = o.join(n, [*SESSION, "family"])
    return j.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.abs(d) > moved_s).alias("moved"), F.avg(d).alias("mean_s"), F.min(d).alias("least_s"), F.max(d).alias("most_s"))


def censor_counts(labels: DataFrame) -> DataFrame:
    """(kind, value, n): censor reasons and quality flags of a profile, flags by their name before the colon."""
    reasons = labels.where("censored").select(F.lit("reason").alias("kind"), F.col("censor_reason").alias("value"))
    flags = labels.select(F.explode("quality_flags").alias("flag")).select(F.lit("flag").alias("kind"), F.substring_index("flag", ":", 1).alias("value"))
    return reasons.unionByName(flags).groupBy("kind", "value").agg(F.count("*").alias("n"))


def latency_evidence(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Response times by message and class of session: n, p50, p99 (at index round-half-even(p (n - 1))), max, per cent over the limit."""
    from ..functions import constants as K

    limit = K.lookup({k[:-3] + "Res": v for k, v in K.MSG_TIMEOUT_S.items()}, F.col("msg"))
    j = rows.where("req_res_latency IS NOT NULL").select(*SESSION, "msg", "req_res_latency").join(labels.select(*SESSION, F.col("first_fault_t").isNotNull().alias("faulty")), list(SESSION))
    x = F.col("req_res_latency")
    out = j.groupBy("msg", "faulty").agg(F.count("*").alias("n"), F.max(x).alias("most"), share(100 * F.count_if(x > limit), F.count("*")).alias("over"))
    at = lambda p: F.bround((F.col("n") - 1) * F.lit(p), 0)
    return out.join(order_statistics(j, "req_res_latency", {"p50": at(0.5), "p99": at(0.99)}, "msg", "faulty"), ["msg", "faulty"])


def span_evidence(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Longest sequence gap, Ongoing span and cable check of each session by class: n, p50, p99, max, share past the limit, and a verdict.

    A limit "separates" where faulty sessions pass it at least twice as often as clean ones, else it is "flat"; needs conformance features.
    """
    limits = {"seq_gap_s": 60.0, "ongoing_s": 60.0, "cablecheck_s": 40.0, "comm_setup_s": 20.0}
    most = rows.groupBy(*SESSION).agg(*[F.max(c).alias(c) for c in limits])
    j = most.join(labels.select(*SESSION, F.col("first_fault_t").isNotNull().alias("faulty")), list(SESSION))
    long = j.select("faulty", F.explode(F.array(*[F.struct(F.lit(c).alias("timer"), F.col(c).alias("x"), F.lit(v).alias("limit")) for c, v in limits.items()])).alias("s")).select("faulty", "s.*")
    out = long.groupBy("timer", "faulty").agg(F.count("*").alias("n"), F.max("x").alias("most"), share(F.count_if(F.col("x") >= F.col("limit")), F.count("*")).alias("past"))
    at = lambda p: F.bround((F.col("n") - 1) * F.lit(p), 0)
    out = out.join(order_statistics(long, "x", {"p50": at(0.5), "p99": at(0.99)}, "timer", "faulty"), ["timer", "faulty"])
    side = lambda f: F.max(F.when(F.col("faulty") == f, F.col("past"))).over(Window.partitionBy("timer"))
    return out.withColumn("verdict", F.when(F.coalesce(side(True), F.lit(0.0)) >= 2 * F.coalesce(side(False), F.lit(0.0)), "separates").otherwise("flat"))


def projected(alerts: DataFrame, fires: DataFrame, adopting: list[str]) -> DataFrame:
    """First alerts if the adopting detectors also had a rule: the earlier of the recorded alert and the rule's."""
    base = fires.select(*SESSION).distinct().crossJoin(F.broadcast(fires.sparkSession.createDataFrame([(a,) for a in adopting], "detector string")))
    keys = alerts.select(*SESSION, "detector").unionByName(base).distinct()
    fire = fires.select(*SESSION, F.col("t").alias("_f"))
    j = keys.join(alerts.select(*SESSION, "detector", F.col("t").alias("_a")), [*SESSION, "detector"], "left").join(fire, list(SESSION), "left")
    return j.withColumn("t", F.when(F.col("detector").isin(*adopting), F.least("_a", "_f")).otherwise(F.col("_a"))).where("t IS NOT NULL").select(*SESSION, "detector", "t")


# fixed values: the waits of the sweep, in seconds
WAITS = (0.2, 0.4, 0.6, 0.8, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0)


def wait_sweep(trace: DataFrame, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """(wait, session, t): when a rule that waits so long would first fire, from rows (session, age_s, t); one pass for all waits."""
    fires = trace.groupBy(*SESSION).agg(*[F.min(F.when(F.col("age_s") >= w, F.col("t"))).alias(f"_{i}") for i, w in enumerate(waits)])
    each = F.array_compact(F.array(*[F.when(F.col(f"_{i}").isNotNull(), F.struct(F.lit(float(w)).alias("wait"), F.col(f"_{i}").alias("t"))) for i, w in enumerate(waits)]))
    return fires.select(*SESSION, F.explode(each).alias("f")).select("f.wait", *SESSION, "f.t")


def wait_scores(labels: DataFrame, alerts: DataFrame, sweep: DataFrame, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """Scores by wait of one detector whose first alert is the earlier of its own (session, t) and the rule's at that wait."""
    table = labels.sparkSession.createDataFrame([(float(w),) for w in waits], "wait double")  # a short list
    base = labels.select(*SESSION, "first_fault_t", "first_fault_family").join(alerts.select(*SESSION, F.col("t").alias("_a")), list(SESSION), "left").crossJoin(F.broadcast(table))
    j = base.join(sweep.select("wait", *SESSION, F.col("t").alias("_f")), ["wait", *SESSION], "left").withColumn("alert_t", F.least("_a", "_f"))
    return scored(judged(j), "wait")


def agreement(projected: DataFrame, replayed: DataFrame) -> DataFrame:
    """Per detector, how many first-alert times of two ways are the same, nulls included."""
    key = [*SESSION, "detector"]
    j = projected.select(*key, F.col("t").alias("a")).join(replayed.select(*key, F.col("t").alias("b")), key, "full")
    return j.groupBy("detector").agg(F.count("*").alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def abort_audit(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Evidence tags of each SESSION_ABORT session from its conformance features."""
    m = rows.groupBy(*SESSION).agg(F.max("msg_timeout_ratio").alias("a"), F.max("seq_gap_s").alias("b"), F.max("ongoing_s").alias("c"), F.max("dialog").alias("d"), F.bool_or((F.col("kind") == "tcp") & (F.col("msg") == "RST")).alias("e"))
    tags = F.array_compact(F.array(F.when(F.col("a") >= 1, "unanswered"), F.when(F.col("b") >= 60, "idle"), F.when(F.col("c") >= 60, "ongoing"), F.when(F.col("d") > 1, "redialog"), F.when(F.col("e"), "rst")))
    return labels.where("first_fault_family = 'SESSION_ABORT'").select(*SESSION).join(m.withColumn("tags", tags).select(*SESSION, "tags"), list(SESSION))


# fixed values: criterion, feature, limit; the first eight have no equivalent in the strict labels
CRITERIA = {
    "Ongoing 60 s": ("ongoing_ratio", 1.0), "sequence 60 s": ("seq_timeout_ratio", 1.0), "setup 20 s": ("comm_setup_s", 20.0), "cable check 40 s": ("cablecheck_breach", 1.0),
    "pre-charge 7 s": ("precharge_breach", 1.0), "message timeout": ("msg_timeout_ratio", 1.0), "illegal successor": ("seq_illegal", 1.0), "dialog reopened": ("dialog", 2.0),
    "response failed": ("rc_sev", 1.0), "EVSE status": ("evse_sev", 1.0), "isolation fault": ("isolation_sev", 1.0), "EV error": ("ev_err_sev", 1.0),
}
NEW_CRITERIA = tuple(CRITERIA)[:8]


def _criteria_met(rows: DataFrame, labels: DataFrame) -> DataFrame:
    most = rows.groupBy(*SESSION).agg(*[F.max(F.col(c).cast("double")).alias(c) for c in sorted({c for c, _ in CRITERIA.values()})])
    hits = F.array_compact(F.array(*[F.when(F.col(c) >= v, name) for name, (c, v) in CRITERIA.items()]))
    return most.withColumn("hits", hits).select(*SESSION, "hits").join(labels.select(*SESSION, "first_fault_t", "first_fault_family"), list(SESSION))


def criterion_audit(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """For each criterion, for "any" and for "new only": sessions that meet it, among them faulty and clean ones."""
    new = F.exists("hits", lambda h: h.isin(*NEW_CRITERIA))
    named = F.concat("hits", F.when(F.size("hits") > 0, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>")), F.when(new, F.array(F.lit("new only"))).otherwise(F.array().cast("array<string>")))
    j = _criteria_met(rows, labels).select("first_fault_t", F.explode(named).alias("criterion"))
    return j.groupBy("criterion").agg(F.count("*").alias("n"), F.count_if(F.col("first_fault_t").isNotNull()).alias("on_faulty"), F.count_if(F.col("first_fault_t").isNull()).alias("on_clean"))


def unmet_by_family(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(family, n): faulty sessions that meet no criterion."""
    return _criteria_met(rows, labels).where("first_fault_t IS NOT NULL AND size(hits) = 0").groupBy(F.col("first_fault_family").alias("family")).agg(F.count("*").alias("n"))


def fleet(labels: DataFrame) -> DataFrame:
    """By station: sessions, faulty, delivered and graceful shares, true median of minutes."""
    minutes = (F.col("t_end") - F.col("t_start")) / 60
    return labels.groupBy("station").agg(F.count("*").alias("n"), F.count_if(F.col("first_fault_t").isNotNull()).alias("faulty"), share(F.count_if(F.col("reached_current_demand")), F.count("*")).alias("delivered"), share(F.count_if(F.col("graceful_close")), F.count("*")).alias("graceful"), F.percentile(minutes, F.lit(0.5)).alias("median_min"))


def corroborated_detection(audit: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(detector, corroborated, n, detected): abort sessions with and without evidence tags, and how many were caught."""
    tagged = audit.select(*SESSION, (F.size("tags") > 0).alias("corroborated"))
    return tagged.join(outcomes.select(*SESSION, "detector", "outcome"), list(SESSION)).groupBy("detector", "corroborated").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "tp").alias("detected"))


def by_source(outcomes: DataFrame, sources: DataFrame, *names: str) -> DataFrame:
    """(detector, recall_<source>, far_<source>, spread): scores by the stations' source (station, source), and the widest gap in recall."""
    g = scored(outcomes.join(sources, "station"), "detector", "source")
    wide = g.groupBy("detector").pivot("source", list(names)).agg(F.first("recall").alias("recall"), F.first("far").alias("far"))
    spread = g.groupBy("detector").agg((F.max("recall") - F.min("recall")).alias("spread"))
    return wide.select("detector", *[F.col(f"{n}_{m}").alias(f"{m}_{n}") for n in names for m in ("recall", "far")]).join(spread, "detector")


def fault_rates(labels: DataFrame, n: int = 15) -> DataFrame:
    """(station, n, faulty, rate): the stations with the highest fault rates, of equals by name; the limit is the report's length."""
    g = labels.groupBy("station").agg(F.count("*").alias("n"), F.count("first_fault_t").alias("faulty")).withColumn("rate", F.col("faulty") / F.col("n"))
    return g.orderBy(F.desc("rate"), "station").limit(n)


def totals(stations: DataFrame, split: str | None = None, name_part: str = "") -> DataFrame:
    """One row over station rows (station, split, sessions, n_faulty): stations, sessions, faulty of those that match, and hidden, how many do not."""
    match = F.col("station").contains(name_part) if split is None else (F.col("split") == split) & F.col("station").contains(name_part)
    m = F.coalesce(match, F.lit(False))
    return stations.agg(F.count_if(m).alias("stations"), F.coalesce(F.sum(F.when(m, F.col("sessions"))), F.lit(0)).alias("sessions"), F.coalesce(F.sum(F.when(m, F.col("n_faulty"))), F.lit(0)).alias("n_faulty"), F.count_if(~m).alias("hidden"))


def rescored(alerts: DataFrame, labels: DataFrame, detectors: DataFrame) -> DataFrame:
    """Scores of recorded first alerts under another label set; sessions that it does not have take no part."""
    return scored(outcomes(labels, alerts, detectors), "detector")


def without(outcomes: DataFrame, questioned: DataFrame) -> DataFrame:
    """Scores without the questioned sessions."""
    return scored(outcomes.join(questioned.select(*SESSION).distinct(), list(SESSION), "left_anti"), "detector")


def generations(boards: DataFrame, names: list[str], metric: str = "score") -> DataFrame:
    """(detector, arm, one column per generation, change): a metric of boards (generation, arm, detector) side by side, and last minus first."""
    wide = boards.groupBy("detector", "arm").pivot("generation", names).agg(F.first(metric))
    return wide.withColumn("change", F.col(f"`{names[-1]}`") - F.col(f"`{names[0]}`"))


def matched_grid(board: DataFrame, grids: DataFrame, n_detectors: int = 5) -> DataFrame:
    """(grid, matches, relation): published grids (grid, detector, score, recall, far, to one decimal) against a leaderboard.

    "same" where all detectors agree in the three to one decimal, "different" where not; "unknown" if the board
    does not have exactly ``n_detectors`` scored rows.
    """
    one = lambda c: F.round(F.col(c), 1)
    full = board.where("score IS NOT NULL AND recall IS NOT NULL AND far IS NOT NULL")
    j = grids.join(full.select("detector", one("score").alias("_s"), one("recall").alias("_r"), one("far").alias("_f")), "detector", "left")
    same = (one("score") == F.col("_s")) & (one("recall") == F.col("_r")) & (one("far") == F.col("_f"))
    g = j.groupBy("grid").agg(F.count_if(F.coalesce(same, F.lit(False))).alias("matches"))
    known = full.agg((F.count("*") == n_detectors).alias("_known"))
    relation = F.when(~F.col("_known"), "unknown").when(F.col("matches") == n_detectors, "same").otherwise("different")
    return g.crossJoin(F.broadcast(known)).select("grid", "matches", relation.alias("relation"))  # one row
