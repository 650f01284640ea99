"""Streams of texts: stateless analysis, and sessions that compare each version with the one before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from inkscan.operators.scoring import fired, keep_last
from inkscan.plans.analyze import analyze

KEEP = 20
#: How late a version may come, and how long after its last version a session's state is kept.
LATE, IDLE = "1 hour", "1 day"
OUTPUT = "session_id string, version long, at timestamp, score double, score_before double, closed string, opened string, remaining string"
STATE = "last long, ids array<long>, ats array<long>, scores array<double>, fired array<string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def score_stream(stream: DataFrame, keep: list[str]) -> DataFrame:
    """Reports of a streaming DataFrame with a ``text`` column: the plan is narrow, so nothing changes."""
    return analyze(stream, keep)


class Sessions(StatefulProcessor):
    """The last versions of each session, and a timer that ends the session when none has come for a while."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getValueState("versions", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, ids, ats, scores, seen = self.versions.get() if self.versions.exists() else (0, [], [], [], [])
        ids, ats, scores, seen, out = list(ids), list(ats), list(scores), list(seen), []
        for row in pd.concat(list(rows)).sort_values(["at", "score"]).itertuples():
            at = int(row.at.value // 1000)  # microseconds
            last += 1
            if row.fresh and (not ats or at >= ats[-1]):  # a new analysis starts the history anew
                ids, ats, scores, seen = [], [], [], []
            # a version that comes late stands where it belongs in time: it is held against the one before it
            place = sum(a <= at for a in ats)
            now = [r for r in row.fired.split(",") if r]
            was = [r for r in seen[place - 1].split(",") if r] if place else None
            parts = [[], [], []] if was is None else [[r for r in was if r not in now], [r for r in now if r not in was], [r for r in now if r in was]]
            out.append((key[0], last, row.at, row.score, scores[place - 1] if place else None, *(",".join(sorted(p)) for p in parts)))
            for kept, value in ((ids, last), (ats, at), (scores, row.score), (seen, row.fired)):
                kept.insert(place, value)
                del kept[:-KEEP]
        self.versions.update((last, ids, ats, scores, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ats[-1] // 1000 + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.versions.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def recheck_stream(stream: DataFrame, late: str = LATE, idle: str = IDLE, ids: list[str] | None = None) -> DataFrame:
    """(session_id, at, fresh, text) in; per version its score, the one before, and findings closed, opened and remaining.

    ``at`` is a timestamp after 1970, where the watermark begins.  Versions that are later than ``late`` behind the latest one are dropped; within that a late version
    is held against the version before it in time.  A session's state is its last 20 versions, and goes once the
    watermark is ``idle`` past its last one: what then comes is a session anew, from version 1.  Findings
    are those of ``scoring.diff``: detectors, or combinations.  Sets the session's state store, which
    timers need.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    idle_ms = spark.sql(f"select unix_millis(timestamp_seconds(0) + interval {idle})").first()[0]
    scored = analyze(stream, ["session_id", "at", "fresh"], ids).select("session_id", "at", "fresh", "score", F.array_join(fired(F.col("advice")), ",").alias("fired"))
    keyed = scored.withWatermark("at", late).groupBy("session_id")
    return keyed.transformWithStateInPandas(Sessions(idle_ms), OUTPUT, "Append", "EventTime")


def store_history(versions: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query that appends every version to files under ``path``; with ``once`` it ends with what there is now."""
    writer = versions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def load_history(spark: SparkSession, path: str, keep: int = KEEP) -> DataFrame:
    """The last ``keep`` versions of each stored session."""
    return keep_last(spark.read.parquet(path), "session_id", "version", keep)
