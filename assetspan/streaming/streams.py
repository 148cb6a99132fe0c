"""Streams of captures and of responses; each replays without doing anything twice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assetspan.functions.hashes import job_id
from assetspan.operators.apply import Applied, apply_rounds
from assetspan.operators.decisions import envelopes, validate_decisions, validate_updates
from assetspan.operators.jobs import reading_order
from assetspan.operators.quality import integrity_violations
from assetspan.session import cut, kept, small
from assetspan.sources import commits
from assetspan.streaming import state


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None while there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _unknown(new: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows of a batch whose job_id the table lacks; of the table only the ids that the batch has are kept before the join."""
    if known is None:
        return new
    return new.join(known.select("job_id").join(small(new.select("job_id")), "job_id", "left_semi"), "job_id", "left_anti")


def _once(df: DataFrame) -> DataFrame:
    """One row per job_id, the least of several."""
    rest = [c for c in df.columns if c != "job_id"]
    if not rest:
        return df.distinct()
    return df.groupBy("job_id").agg(F.min(F.struct(*rest)).alias("r")).select("job_id", *(F.col("r").getField(c).alias(c) for c in rest))


def revision_stream(captures: DataFrame, path: str, checkpoint: str):
    """Appends to the table at path each (source_id, document_sha256) that it lacks, as a pending job.  captures: a stream with these and any other columns."""

    def batch(df: DataFrame, _: int) -> None:
        new = _once(df.withColumn("job_id", job_id(F.col("source_id"), F.col("document_sha256")))).persist()
        _unknown(new, _read(df.sparkSession, path)).withColumn("status", F.lit("pending")).write.mode("append").parquet(path)
        new.unpersist()

    return captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_stream(responses: DataFrame, path: str, checkpoint: str, registered: DataFrame, generations: list[str], asset_states: list[str], contract_states: list[str]):
    """Validates and applies arriving responses to the versioned state at path (tables assets and contracts, see streaming.state), a version per batch.

    responses: a stream of job_id, company, payload, source_id, document_sha256, kind, url, published_at.  A batch reads the newest version n, holds, applies
    and checks its documents in reading order against it, and commits n+1 together with its own number and with what it adds to the history:
    outcomes, changes, holds and events.  So a batch that runs again finds its number and does nothing, one that failed before its
    commit has changed nothing, and of two streams at one state the second goes on from the version of the first.  A job is applied once
    however often its response arrives; of several responses of a batch the least counts.  A response that failed is not tried again, another one of that
    job is.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        given = kept(_once(df).withColumn("response_sha256", F.sha2("payload", 256)))
        while True:
            version, record = commits.latest(spark, path, state.NAME)
            if record is None:
                raise ValueError(f"{path} holds no state: begin with streaming.state.start()")
            if record["streams"].get(stream, -1) >= number:
                return
            todo = _unanswered(given, state.history(spark, path, "outcomes"))
            if todo.isEmpty():
                return
            now = state.read(spark, path, record)
            done, keys = _applied(todo, now["assets"], now["contracts"], registered, generations, asset_states, contract_states)
            shas = todo.select("job_id", "response_sha256")
            added = {"outcomes": done.outcomes.join(shas, "job_id"), "changes": done.changes, "holds": done.holds, "events": done.events}
            if state.advance(spark, path, version, record, {"assets": done.assets, "contracts": done.contracts}, keys, added, stream, number):
                return

    return responses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _unanswered(given: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Responses of jobs that have not succeeded and that have not failed by this response; only buckets that the batch has are read."""
    if outcomes is None:
        return given
    buckets = [r[0] for r in given.select(state.bucket("job_id")).distinct().collect()]
    known = outcomes.where(F.col("state_bucket").isin(buckets)).select("job_id", "response_sha256", "outcome")
    succeeded = known.where("outcome <> 'failed'").select("job_id")
    return kept(given.join(succeeded, "job_id", "left_anti").join(known.where("outcome = 'failed'"), ["job_id", "response_sha256"], "left_anti"))


def _applied(todo: DataFrame, assets: DataFrame, contracts: DataFrame, registered: DataFrame, generations: list[str], asset_states: list[str], contract_states: list[str]) -> tuple[Applied, DataFrame]:
    """What the responses do to the state, and the assets that they name; a response that is none has failed."""
    documents = todo.select("job_id", "company", "source_id", "document_sha256", "kind", "url", "published_at").withColumn("input_mode", F.lit(None).cast("string"))
    ordered = cut(reading_order(documents).select("job_id", "source_id", "document_sha256", "kind", "url", "published_at", "round"))
    told = kept(validate_decisions(todo, assets, contracts, contract_states).join(ordered, "job_id"))
    news = kept(validate_updates(todo, assets, asset_states).join(ordered.select("job_id", "round"), "job_id"))
    check = lambda a, c: integrity_violations(a, c, registered, generations, asset_states, contract_states)
    done = apply_rounds(assets, contracts, told, check, news)
    empty = envelopes(todo).select("job_id", F.when(F.col("reject_reason").isNotNull(), "failed").otherwise("no-change").alias("outcome"))
    done.outcomes = done.outcomes.union(empty.join(done.outcomes, "job_id", "left_anti"))
    return done, told.select("asset_id").union(news.select("asset_id")).where("asset_id is not null").distinct()


#: Where keyed state is kept: only changes are written with a batch, whole snapshots now and then.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class _Newest(StatefulProcessor):
    """A source's newest revision, kept until its time is over."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, document_sha256 string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = max((r["at"], r["document_sha256"]) for r in rows)
        known = self.newest.get()
        if known is not None and tuple(known) >= found:
            return
        self.newest.update(found)
        if known is not None:
            self.handle.deleteTimer(self._end(known[0]))
        self.handle.registerTimer(self._end(found[0]))
        yield Row(source_id=key[0], document_sha256=found[1], at=found[0])

    def _end(self, at: int) -> int:
        """Milliseconds at which what came at these microseconds expires."""
        return at // 1000 + self.keep_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_revision(captures: DataFrame, delay: str = "1 day", keep_days: int = 30) -> DataFrame:
    """Of a stream (source_id, document_sha256, captured_at as timestamp) the revisions that are newer than all of their source before, in update mode.

    Older and repeated revisions emit nothing.  Captures that come more than `delay` after the newest one of all sources are late and go; a source's
    state goes when nothing newer has come for keep_days of the captures' time, when what is older than it would be late anyway.
    """
    for name, value in STATE_STORE.items():
        captures.sparkSession.conf.set(name, value)
    given = captures.where("captured_at is not null and document_sha256 is not null").select("source_id", "document_sha256", "captured_at", F.unix_micros("captured_at").alias("at"))
    keyed = given.withWatermark("captured_at", delay).groupBy("source_id")
    found = keyed.transformWithState(_Newest(keep_days * 86_400_000), "source_id string, document_sha256 string, at long", "Update", "EventTime")
    return found.select("source_id", "document_sha256", F.timestamp_micros("at").alias("captured_at"))
