"""Transcripts, chats, worker logs and state histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.constants import STATE_MATRIX
from callgrove.functions.times import micros
from callgrove.plans.chunked import neighbour, running


def query_log(df: DataFrame, session_id: str | None = None, phase: str | None = None, step: str | None = None,
              command: str | None = None, status: str | None = None) -> DataFrame:
    """Log records by session, phase (compared as text), substrings of step and command, and status."""
    out = df.filter(F.col("_type") == "log")
    if session_id is not None:
        out = out.filter(F.col("session_id").cast("string") == session_id)
    if phase is not None:
        out = out.filter(F.col("phase").cast("string") == str(phase))
    if step is not None:
        out = out.filter(F.coalesce("step", F.lit("")).contains(step))
    if command is not None:
        out = out.filter(F.coalesce("command", F.lit("")).contains(command))
    if status is not None:
        out = out.filter(F.col("status") == status)
    return out


def last_n(df: DataFrame, n: int, order: str = "line_no", keys: list[str] | None = None) -> DataFrame:
    """Last ``n`` rows in log order, of the whole log or of each key."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def current_session(df: DataFrame, keys: list[str]) -> DataFrame:
    """Latest session header of each log and whether that session is still open."""
    start = F.when(F.col("_type") == "session_start", F.struct("line_no"))
    heads = df.groupBy(*keys).agg(F.max_by("session_id", start).alias("session_id"), F.count_if(F.col("_type") == "session_start").alias("total_sessions"),
                                  F.count_if(F.col("_type") == "session_end").alias("closed_sessions"))
    closed = df.filter("_type = 'session_end'").select(*keys, "session_id").distinct().withColumn("closed", F.lit(True))
    return heads.join(closed, [*keys, "session_id"], "left").withColumn(
        "active", F.col("session_id").isNotNull() & F.col("closed").isNull()).drop("closed")


def log_status(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions, and entries, results and phases of the active session, per log."""
    cur = current_session(df, keys)
    logs = df.filter("_type = 'log'").groupBy(*keys, "session_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.array_join(F.sort_array(F.collect_set(F.col("phase").cast("string"))), ",").alias("phases"))
    out = cur.join(logs, [*keys, "session_id"], "left")
    live = lambda c: F.when(F.col("active"), F.coalesce(c, F.lit(0))).otherwise(0)
    return out.select(*keys, F.when(F.col("active"), F.col("session_id")).alias("active_session"), "total_sessions", "closed_sessions",
                      live("entries").alias("entries"), live("ok").alias("ok_count"), (live("entries") - live("ok")).alias("fail_count"),
                      F.when(F.col("active"), F.coalesce("phases", F.lit(""))).otherwise("").alias("phases"))


def close_session(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Close record of every session: entries, elapsed time and phases."""
    at = micros(ts)
    return df.groupBy(*keys, "session_id").agg(
        F.count_if(F.col("_type") == "log").alias("log_entries"),
        F.floor((F.max(at) - F.min(at)) / 1000).cast("long").alias("total_duration_ms"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_type") == "log", F.col("phase").cast("string")))), ",").alias("phases_completed"))


def assign_sessions(df: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Number of the session block each record lies in: a running count of headers."""
    return running(df, keys, order, chunk, (F.col("_type") == "session_start").cast("int"), "session_no", "sum")


def role_counts(chat: DataFrame) -> DataFrame:
    """Messages per role of each file, and the first user text."""
    first = chat.groupBy("file").agg(F.min_by("content", F.when(F.col("role") == "user", F.col("line_no"))).alias("first_user"))
    return chat.groupBy("file", "role").agg(F.count(F.lit(1)).alias("n")).join(first, "file")


def repeat_failures(log: DataFrame, n: int = 3) -> DataFrame:
    return (log.groupBy("role", "failure_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
            .filter(F.col("n") >= n))


def batch_outcome(results: DataFrame) -> DataFrame:
    return results.groupBy("batch").agg(F.count(F.lit(1)).alias("run"), F.count_if(F.col("status") == "OK").alias("ok"),
                                        F.count_if(F.col("status") != "OK").alias("failed"))


def session_usage(sessions: DataFrame, prefix: str) -> DataFrame:
    """Number, tokens and cost of the sessions whose title starts with ``prefix``."""
    return sessions.filter(F.col("title").startswith(prefix)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"),
        F.round(F.sum("cost"), 4).alias("cost"))


def illegal_transitions(events: DataFrame, key: str, ts: str, tie: str, state: str, chunk: Column) -> DataFrame:
    """Consecutive states of an entity that the state matrix does not allow, or not in time."""
    near = neighbour(events, [key], [ts, tie], chunk, F.struct(F.col(state).alias("s"), F.col(ts).alias("at")), "prev")
    frm, to, legal = F.col("prev.s"), F.col(state), F.lit(False)
    for a, b, days in STATE_MATRIX:
        step = (frm == a) & (to == b)
        if days is not None:
            step = step & (micros(ts) - micros(F.col("prev.at")) <= days * 86_400_000_000)
        legal = legal | step
    order = ["PENDING", "PAID", "SHIPPED", "DELIVERED", "CONFIRMED"]
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    kind = (F.when(frm == to, "repeated").when((place(frm) > 0) & (place(to) > 0) & (place(to) < place(frm)), "reversed")
            .when((place(frm) > 0) & (place(to) > place(frm) + 1), "skipped").otherwise("not_allowed"))
    return (near.filter(frm.isNotNull() & ~legal)
            .select(key, tie, ts, frm.alias("from_state"), to.alias("to_state"), kind.alias("fault")))


def racing_updates(events: DataFrame, key: str, ts: str, tie: str, gap_ms: int, chunk: Column) -> DataFrame:
    """Changes of one entity that follow the previous one within ``gap_ms``."""
    near = neighbour(events, [key], [ts, tie], chunk, F.col(ts), "prev_ts")
    gap = micros(ts) - micros("prev_ts")
    return near.filter(gap <= gap_ms * 1000).withColumn("gap_us", gap)
