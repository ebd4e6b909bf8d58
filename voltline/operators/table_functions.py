"""Detectors from SQL: a table function over rows partitioned by session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import detection
from .sessions import SESSION

FIRST_ALERT = "station string, connector string, sid int, t double, confidence double, reason string, fault_guess string"


@udtf(returnType=FIRST_ALERT)
class FirstAlert:
    """The first row of a partition whose alert is set. Call it as
    ``first_alert(TABLE(view) PARTITION BY (station, connector, sid) ORDER BY (t, seq))``; the order makes the first row the earliest."""

    def __init__(self):
        self.found = None

    def eval(self, row: Row) -> None:
        if self.found is None and row["confidence"] is not None:
            self.found = tuple(row[c] for c in ("station", "connector", "sid", "t", "confidence", "reason", "fault_guess"))

    def terminate(self) -> Iterator[tuple]:
        if self.found is not None:
            yield self.found


def register(spark: SparkSession, rows: DataFrame, *detectors: str) -> dict[str, str]:
    """Make ``first_alert`` and a view for each registered detector known to SQL; returns {detector: view}.

    A detector's rules are columns of its view, evaluated before the rows reach Python; rows without an alert stay behind.
    """
    spark.udtf.register("first_alert", FirstAlert)
    views = {}
    for name in detectors or detection.DETECTORS:
        views[name] = f"alerting_{name.lower()}"
        spoken = detection.DETECTORS[name](rows).where("alert IS NOT NULL")
        spoken.select(*SESSION, "t", "seq", *[F.col(f"alert.{c}").alias(c) for c in ("confidence", "reason", "fault_guess")]).createOrReplaceTempView(views[name])
    return views
