"""Structured Streaming: ingest with bounded lateness, session windows, station counts, alerts as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K
from ..functions import scalars as S

LATENESS = "10 minutes"


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))


def ingest(spark: SparkSession, path: str, schema, lateness: str = LATENESS) -> DataFrame:
    """A file stream of telemetry rows; rows that a ring file repeats within the watermark count once."""
    rows = with_time(spark.readStream.schema(schema).parquet(path))
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["station", "connector", "seq"])


def session_windows(events: DataFrame, gap: str = "60 seconds", lateness: str = LATENESS) -> DataFrame:
    """Sessions of activity rows as they close: a gap of exactly ``gap`` joins, a longer one splits (opened dialogs do not split here)."""
    rows = events if "ts" in events.columns else with_time(events)
    if events.isStreaming and "ts" not in events.columns:
        rows = rows.withWatermark("ts", lateness)
    act = rows.where(S.is_activity(F.col("kind"), F.col("msg")))
    out = act.groupBy("station", "connector", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    return out.drop("w")


def station_counts(events: DataFrame, width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Rows, retransmissions and failed responses by station and sliding window."""
    rows = events if "ts" in events.columns else with_time(events)
    out = rows.groupBy("station", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if((F.col("kind") == "tcp") & (F.col("msg") != "RST")).alias("retx"), F.count_if(S.is_failed(F.col("resp_code"))).alias("failed"))
    return out.select("station", F.col("w.start").alias("start"), "n", "retx", "failed")


def marker_alerts(events: DataFrame) -> DataFrame:
    """Rows that state a fault themselves, as alerts; stateless, so batch and stream agree row by row."""
    family = F.when(S.is_failed(F.col("resp_code")), "PROTOCOL_FAILED").when(F.col("evse_status").isin("EVSE_Malfunction", "EVSE_EmergencyShutdown"), "EVSE_FAULT").when(F.col("isolation") == "Fault", "ISOLATION_FAULT").when(~F.col("ev_err").isin("", "NO_ERROR"), "EV_ERROR")
    return events.where("kind = 'v2g'").withColumn("family", family).where("family IS NOT NULL").select("station", "connector", "seq", "t", "family")


def enrich(alerts: DataFrame, policies: DataFrame) -> DataFrame:
    """Stream-static join: alerts with their station's policy."""
    return alerts.join(policies, "station", "left")


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ()) -> StreamingQuery:
    """A table of the stream's rows, one folder per batch; a batch that is replayed rewrites its own, so every batch counts once.

    With ``keys``, a later row of the same keys replaces an earlier one: ``latest`` reads the table so.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.dropDuplicates(list(keys)) if keys else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last batch's row of each key in a table that ``upsert`` writes."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in ("batch", *keys)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return last.select(*keys, "_r.*")


# ---------------------------------------------------------------- first alerts with state and timers

STATE = "last_activity double, closed boolean, open_req string, open_at double, owed_at double, ongoing_at double, n_attempts int, alerted boolean, n_session int"
ALERT = "station string, connector string, session int, t double, family string, reason string"
SESSION_GAP_S = 60.0


class _Dialog:
    """What an open session owes: the request that waits, the response that waits for a request, processing that goes on."""

    def __init__(self, state: tuple | None):
        names = [x.split()[0] for x in STATE.split(", ")]
        start = dict(zip(names, state)) if state else dict.fromkeys(names)
        self.__dict__.update(start)
        self.n_session = self.n_session if self.n_session is not None else -1
        self.alerted, self.closed, self.n_attempts = bool(self.alerted), bool(self.closed), self.n_attempts or 0

    def state(self) -> tuple:
        return tuple(getattr(self, x.split()[0]) for x in STATE.split(", "))

    def begin(self) -> None:
        self.n_session += 1
        self.closed = self.alerted = False
        self.open_req = self.open_at = self.owed_at = self.ongoing_at = None
        self.n_attempts = 0

    def deadlines(self) -> list[tuple[float, str, str]]:
        """(time, family, reason) of the timers that run."""
        out = []
        if self.open_at is not None and self.open_req in K.MSG_TIMEOUT_S:
            out.append((self.open_at + K.MSG_TIMEOUT_S[self.open_req], "COMM_FREEZE", f"Table 109: {self.open_req} unanswered"))
        if self.owed_at is not None:
            out.append((self.owed_at + K.SEQ_TIMEOUT_S, "COMM_FREEZE", "[V2G2-443] no request for 60s"))
        if self.ongoing_at is not None:
            out.append((self.ongoing_at + K.ONGOING_PERFORMANCE_S, "COMM_FREEZE", "[V2G2-711] EVSEProcessing Ongoing 55s"))
        return sorted(out)

    def due(self, now: float) -> tuple[float, str, str] | None:
        """The first timer that ran out by ``now``, unless the session has alerted."""
        found = None if self.alerted else next((d for d in self.deadlines() if d[0] <= now), None)
        self.alerted = self.alerted or found is not None
        return found

    def take(self, r) -> tuple[float, str, str] | None:
        """The alert that row ``r`` of the session raises, and the state after it."""
        act = r.kind in ("v2g", "sdp", "tcp") or (r.kind == "hpav" and any(x in r.msg for x in ("SLAC", "ATTEN_CHAR", "SET_KEY", "VALIDATE")))
        opener = r.kind == "v2g" and r.msg in K.OPENERS
        late = self.due(r.t) if self.n_session >= 0 else None
        if act and (self.last_activity is None or r.t - self.last_activity > SESSION_GAP_S or (opener and self.closed)):
            self.begin()
        if act:
            self.last_activity = r.t
        if self.n_session < 0:
            return None
        stated = None
        if r.kind == "v2g":
            if r.msg.startswith("SessionStop"):
                self.closed = True
            if r.msg.endswith("Req"):
                self.open_req, self.open_at, self.owed_at = r.msg, r.t, None
            elif r.msg.endswith("Res"):
                self.open_req = self.open_at = None
                ends = r.msg == "SessionStopRes" or r.resp_code.upper().startswith("FAILED")
                self.owed_at = None if ends else r.t
                if ends or r.evse_processing == "Finished":
                    self.ongoing_at = None
                elif r.evse_processing == "Ongoing" and self.ongoing_at is None:
                    self.ongoing_at = r.t
            if r.resp_code.upper().startswith("FAILED"):
                stated = (r.t, "PROTOCOL_FAILED", f"rule: ResponseCode {r.resp_code}")
            elif r.evse_status in ("EVSE_Malfunction", "EVSE_EmergencyShutdown"):
                stated = (r.t, "EVSE_FAULT", f"rule: {r.evse_status}")
            elif r.isolation == "Fault":
                stated = (r.t, "ISOLATION_FAULT", "rule: isolation Fault")
            elif r.ev_err not in ("", "NO_ERROR"):
                stated = (r.t, "EV_ERROR", f"rule: EVErrorCode {r.ev_err}")
        elif r.kind == "hpav" and "SLAC_PARM.REQ" in r.msg:
            self.n_attempts += 1
            if self.n_attempts >= 3:
                stated = (r.t, "SLAC_FAILURE", "rule: 3+ SLAC attempts")
        if late is None and stated and not self.alerted:
            self.alerted = True
            return stated
        return late


def first_alerts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(station, connector, session, t, family, reason): the first alert of each open session of a stream of telemetry.

    State is kept by connector: the session's openers and stops, retries, and three of the standard's timers. A timer
    fires when the watermark passes it, so silence alerts without a new row of that connector. Rows of one trigger are
    taken in order of time; rows older than the watermark are dropped by Spark.
    """
    rows = events if "ts" in events.columns else with_time(events).withWatermark("ts", lateness)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dialog, found = _Dialog(state.get if state.exists else None), []

        def note(alert: tuple | None) -> None:
            if alert:
                found.append((*key, dialog.n_session, *alert))

        if state.hasTimedOut:
            note(dialog.due(state.getCurrentWatermarkMs() / 1000.0))
        else:
            for r in pd.concat(list(frames)).sort_values(["t", "seq"]).itertuples():
                before = dialog.n_session
                alert = dialog.take(r)
                if alert:
                    found.append((*key, before if alert[0] < r.t else dialog.n_session, *alert))
        state.update(dialog.state())
        ahead = [] if dialog.alerted else dialog.deadlines()
        if ahead:
            state.setTimeoutTimestamp(max(int(ahead[0][0] * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=[x.split()[0] for x in ALERT.split(", ")])

    return rows.groupBy("station", "connector").applyInPandasWithState(run, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
