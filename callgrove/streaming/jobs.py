"""Structured Streaming jobs over the append-only logs.

Each job is a plain ``DataFrame -> DataFrame`` plan on a stream; built-in windows and aggregates
carry the state, and only the promotion of chains needs a small custom state.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callgrove.constants import PROMOTION_ROUNDS, PROMOTION_THRESHOLD
from callgrove.functions.keys import expire
from callgrove.plans.scratch import scratch_root
from callgrove.session import SETTINGS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", glob: str | None = None) -> DataFrame:
    """A folder of log files as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def distinct_records(stream: DataFrame, key: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop records delivered twice within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def run_to_table(stream: DataFrame, mode: str, name: str, home: str | None = None, idle_batches: bool = True) -> DataFrame:
    """Process what is available and return the sink as a table with a ``batch`` column.

    With ``home``, a folder of the job's own, a later call goes on where the last one ended; without it the
    job starts anew in a scratch folder.  A batch overwrites its own folder, so a retried batch leaves no
    second copy.  A source without files gives an empty table.  State with a lifetime in processing time asks for a
    batch without input again and again; ``idle_batches=False`` makes none, so that the run ends.  Only RocksDB holds such
    state, so the query gets it whatever the session's store is.
    """
    spark = stream.sparkSession
    home = home or f"{scratch_root(spark)}/{name}-{uuid4().hex}"
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{home}/rows/batch={batch}")
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    if not idle_batches:
        settings[STATE_STORE] = SETTINGS[STATE_STORE]
    given = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():  # a query keeps the settings it was started with
        spark.conf.set(k, v)
    try:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint")
                 .trigger(availableNow=True).foreachBatch(write).start())
    finally:
        for k, v in given.items():
            spark.conf.set(k, v)
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{home}/rows")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # no batch was needed
            return spark.createDataFrame([], schema)
        raise


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last state per key of a table written in update mode."""
    values = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def heartbeat(events: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Killed workers: a worker's session ends ``timeout`` after its last sign of life.

    A session window holds just that state; it is emitted once the watermark has passed its end,
    and signs of life older than the watermark are dropped.
    ``events(worker, ts, done)`` with ``done`` true for completed work items.
    """
    s = F.session_window("ts", timeout)
    out = events.withWatermark("ts", delay).groupBy(s.alias("w"), "worker").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("remaining"))
    return out.select("worker", F.col("w.start").alias("first_seen"), F.col("w.end").alias("killed_at"), "n_events", "completed", "remaining")


def debounce(changes: DataFrame, quiet: str = "2 seconds", delay: str = "10 minutes") -> DataFrame:
    """One sync per burst of changes of a project."""
    out = changes.withWatermark("ts", delay).groupBy(F.session_window("ts", quiet).alias("w"), "project").agg(F.count(F.lit(1)).alias("n_changes"))
    return out.select("project", F.col("w.start").alias("first_change"), F.col("w.end").alias("sync_at"), "n_changes")


def failure_alerts(failures: DataFrame, n: int = 3) -> DataFrame:
    """Groups with ``n`` or more failures of one type so far (update mode)."""
    counts = failures.groupBy("role", "failure_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return counts.filter(F.col("n") >= n)


def prune_rates(log: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Prunings per rule and tumbling window."""
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return out.select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "rule_id", "hits")


def false_kill_share(log: DataFrame, size: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Share of false kills per rule over a sliding window."""
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "rule_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if("false_kill").alias("false_kills"))
    return out.select(F.col("w.start").alias("from_ts"), "rule_id", "hits", "false_kills", F.round(F.col("false_kills") / F.col("hits"), 6).alias("share"))


def session_status(lines: DataFrame, closed: DataFrame) -> DataFrame:
    """Results per open session and phase: the stream joined with the known closed sessions."""
    open_lines = lines.filter("_type = 'log'").join(closed.select("session_id").distinct().withColumn("closed", F.lit(True)), "session_id", "left")
    return open_lines.filter("closed is null").groupBy("session_id", "phase").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("fail"))


def expire_stream(writes: DataFrame) -> DataFrame:
    """Cache writes that are still alive when they are processed."""
    return expire(writes, F.current_timestamp())


ROUND = np.dtype([("known", "?"), ("chain_id", "<i8"), ("round", "<i8"), ("score", "<i8"), ("renewed", "<i8")])
NO_ROUND, NO_SCORE = -2**63, 2**63 - 1  # what stands for null: below every round, above every score


class LastRounds(StatefulProcessor):
    """The last ``k`` rounds of the chains of one piece, packed into one value, so that state is asked for once for all of them.

    A chain that is not renewed for ``lifetime_ms`` is forgotten, and so is a piece.
    """

    def __init__(self, k: int, threshold: int, lifetime_ms: int):
        self.k, self.threshold, self.lifetime_ms = k, threshold, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chains = handle.getValueState("chains", "rounds binary", self.lifetime_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), self.chains.get()
        kept = np.frombuffer(held[0], ROUND) if held else np.empty(0, ROUND)
        kept = kept[now - kept["renewed"] < self.lifetime_ms]
        fresh = np.zeros(len(kept), bool)
        for pdf in rows:
            came = np.empty(len(pdf), ROUND)
            for c in ("known", "chain_id", "round", "score"):
                came[c] = pdf[c]
            came["renewed"] = now
            kept, fresh = self._last(np.concatenate([kept, came]), np.concatenate([fresh, np.ones(len(came), bool)]))
        self.chains.update((kept.tobytes(),))
        yield self._states(kept[fresh])

    def _last(self, rows: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last ``k`` rounds of each chain in order; of equal rounds the one that came last."""
        order = np.lexsort((rows["round"], rows["chain_id"], rows["known"]))
        rows, fresh = rows[order], fresh[order]
        first, sizes = _groups(rows)
        rows["renewed"] = np.repeat(np.maximum.reduceat(rows["renewed"], first), sizes)
        fresh = np.repeat(np.logical_or.reduceat(fresh, first), sizes)
        lost = np.repeat(np.logical_or.reduceat(rows["round"] == NO_ROUND, first), sizes)
        final = np.append(rows["round"][1:] != rows["round"][:-1], True)
        final[first[1:] - 1] = True
        plain = np.flatnonzero(final & ~lost)
        first, sizes = _groups(rows[plain])
        plain = plain[np.repeat(first + sizes, sizes) - np.arange(len(plain)) <= self.k]
        came = np.flatnonzero(lost)
        pick = np.append(plain, self._unordered(rows, came[np.argsort(order[came])])) if len(came) else plain
        return rows[pick], fresh[pick]

    def _unordered(self, rows: np.ndarray, came: np.ndarray) -> list[int]:
        """The places of the last ``k`` rounds of chains with a round that is null, which sorts as NaN does, where it came."""
        chains: dict[tuple, dict] = {}
        for i, known, chain, number in zip(came.tolist(), *(rows[c][came].tolist() for c in ("known", "chain_id", "round"))):
            chains.setdefault((known, chain), {})[float("nan") if number == NO_ROUND else number] = i
        return [kept[number] for kept in chains.values() for number in sorted(kept)[-self.k:]]

    def _states(self, rows: np.ndarray) -> pd.DataFrame:
        """A null decides where it is the first of a chain, and is passed over behind others, as NaN is by ``max`` and ``min``."""
        first, sizes = _groups(rows)
        known, scored = rows["round"][first] != NO_ROUND, rows["score"][first] != NO_SCORE
        hi, lo = np.maximum.reduceat(rows["round"], first), np.minimum.reduceat(np.where(rows["round"] == NO_ROUND, -1 - NO_ROUND, rows["round"]), first)
        worst = np.minimum.reduceat(rows["score"], first)
        whole = (sizes == self.k) & known & (np.where(known, hi, 0) - np.where(known, lo, 0) == self.k - 1)
        given = lambda values, there: pd.Series(pd.arrays.IntegerArray(values.astype("int64"), ~there))
        return pd.DataFrame({"chain_id": given(rows["chain_id"][first], rows["known"][first]), "last_round": given(hi, known),
                             "worst": given(worst, scored), "promoted": whole & scored & (worst > self.threshold)})

    def close(self) -> None:
        pass


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chain begins in ordered rows, and its number of rows."""
    other = (rows["chain_id"][1:] != rows["chain_id"][:-1]) | (rows["known"][1:] != rows["known"][:-1])
    first = np.flatnonzero(np.append(True, other)) if len(rows) else np.empty(0, int)
    return first, np.diff(np.append(first, len(rows)))


def promote_stream(scores: DataFrame, k: int = PROMOTION_ROUNDS, threshold: int = PROMOTION_THRESHOLD, lifetime_ms: int = 30 * 86_400_000, pieces: int = 16_384) -> DataFrame:
    """Promotion state per chain after each batch: the last ``k`` rounds are kept, nothing else, and for ``lifetime_ms`` only.

    ``scores(chain_id, round, score)``; a repeated round replaces its score.  A run that is to end with its input needs
    ``idle_batches=False``.  Chains are dealt to ``pieces`` by their hash; a batch reads and writes the state of the pieces it has
    chains of, so small batches over very many chains want more pieces.  A stream with a home keeps to its number of pieces.
    """
    number = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none).cast("long")).alias(c)
    rows = scores.select(F.pmod(F.xxhash64("chain_id"), F.lit(pieces)).cast("int").alias("piece"), F.col("chain_id").isNotNull().alias("known"),
                         number("chain_id", 0), number("round", NO_ROUND), number("score", NO_SCORE))
    out = "chain_id long, last_round int, worst int, promoted boolean"
    return rows.groupBy("piece").transformWithStateInPandas(LastRounds(k, threshold, lifetime_ms), out, "Update", "ProcessingTime")
