"""The request log as a stream: counts by window, limits with state, ratings joined to questions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import DAY, SlidingLimit, fold_cooldown, fold_tickets
from ..sources.io import parse_log

DAY_MS = DAY * 1000


def stream_log(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Events of a folder of JSON-lines files that grows, with their time as ts."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return parse_log(reader.load(folder)).withColumn("ts", F.try_to_timestamp("czas"))


def stream_daily(df: DataFrame, late: str = "1 day") -> DataFrame:
    rows = df.filter("typ is null").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("wynik") == "odmowa").alias("refusals"), F.round(F.sum("koszt_usd"), 6).alias("cost_usd")).select(F.to_date("w.start").alias("day"), "questions", "refusals", "cost_usd")


def stream_rate(df: DataFrame, key: str, length: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(key, F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch, by time."""
    return pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")


def _expire(state: GroupState, last: float) -> None:
    """A key's state goes once the watermark is a day past the last time that matters for it."""
    state.setTimeoutTimestamp(max(int(last * 1000) + DAY_MS, state.getCurrentWatermarkMs() + 1))


def stream_admit(df: DataFrame, key: str, per_min: int, per_day: int, late: str = "1 hour") -> DataFrame:
    """admit_requests() live: the accepted times of the last day are a key's state, dropped a day after the last."""

    def of(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        limit = SlidingLimit(per_min, per_day, state.get[0] if state.exists else [])
        rows = _in_order(batches)
        admitted = [limit.admit(t) for t in rows["t"]]
        state.update((list(limit.times),))
        _expire(state, rows["t"].max())
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"].to_numpy(), "admitted": admitted})

    rows = df.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "seq", "ts", (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(of, "key string, seq long, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_cooldown(df: DataFrame, seconds: int = 600, late: str = "1 hour") -> DataFrame:
    """address_cooldown() live: the time until which an address is blocked is its state."""

    def of(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows = _in_order(batches)
        accepted, until = fold_cooldown(list(zip(rows["t"], rows["outcome"], rows["correction"])), until, seconds)
        state.update((until,))
        _expire(state, max(rows["t"].max(), until or 0.0))
        yield pd.DataFrame({"address": k[0], "seq": rows["seq"].to_numpy(), "accepted": accepted})

    rows = df.withWatermark("ts", late).select(F.lower("email").alias("address"), "seq", "ts", (F.unix_micros("ts") / 1e6).alias("t"), "outcome", F.coalesce("correction", F.lit(False)).alias("correction"))
    return rows.groupBy("address").applyInPandasWithState(of, "address string, seq long, accepted boolean", "until double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_tickets(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """correction_tickets() live: seq and allowed of mails (ticket, email, ts, seq, outcome, correction) with a ticket.

    A ticket's state is whose it is and whether it is open; it goes a day after its last mail. A mail that the watermark of
    the batch before has passed is dropped; within a micro-batch a ticket's mails are taken in order of time.
    """

    def of(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        owner, is_open = state.get if state.exists else (None, False)
        rows = _in_order(batches)
        allowed, owner, is_open = fold_tickets(list(zip(rows["address"], rows["outcome"], rows["correction"])), owner, bool(is_open))
        state.update((owner, is_open))
        _expire(state, rows["t"].max())
        yield pd.DataFrame({"ticket": k[0], "seq": rows["seq"].to_numpy(), "allowed": pd.array(allowed, dtype="boolean")})

    rows = df.filter("ticket is not null").withWatermark("ts", late).select("ticket", F.lower("email").alias("address"), "seq", "ts", (F.unix_micros("ts") / 1e6).alias("t"), "outcome", F.coalesce("correction", F.lit(False)).alias("correction"))
    return rows.groupBy("ticket").applyInPandasWithState(of, "ticket string, seq long, allowed boolean", "owner string, is_open boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_gate_signal(df: DataFrame, key: str, window: int = 50, threshold: float = 0.2) -> DataFrame:
    """skipped_gate_signal() live: the last flags of a key and whether it was active are its state."""

    def of(k, batches, state: GroupState):
        flags, active = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        rows = _in_order(batches)
        out = []
        for skipped in rows["skipped"]:
            flags = [*flags, bool(skipped)][-window:]
            share = sum(flags) / len(flags)
            now = len(flags) == window and share > threshold
            out.append((share, now, now and not active))
            active = now
        state.update((flags, active))
        share, on, alert = zip(*out)
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"].to_numpy(), "share": share, "active": on, "alert": alert})

    rows = df.select(F.col(key).cast("string").alias("key"), "seq", (F.unix_micros("ts") / 1e6).alias("t"), "skipped")
    return rows.groupBy("key").applyInPandasWithState(of, "key string, seq long, share double, active boolean, alert boolean", "flags array<boolean>, active boolean", "append", GroupStateTimeout.NoTimeout)


def stream_rating_cases(df: DataFrame, within: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Ratings with the outcome of their question, asked at most so long before; those without one come with found
    false once the watermark has passed."""
    rated = df.filter("typ = 'ocena'").select("id_zapytania", "ocena", F.col("ts").alias("rated_at")).withWatermark("rated_at", late)
    asked = df.filter("typ is null and id is not null").select(F.col("id").alias("qid"), "wynik", "powod", F.col("ts").alias("asked_at")).withWatermark("asked_at", late)
    near = F.expr(f"id_zapytania = qid AND asked_at <= rated_at AND asked_at >= rated_at - interval {within}")
    return rated.join(asked, near, "leftOuter").withColumn("found", F.col("qid").isNotNull())


def stream_dedup(df: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
