"""Rate limits, cooldowns and correction tickets over request logs: what would have been let through."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Requests a minute and a day by kind of key: fixed defaults.
LIMITS = {"ip": (10, 40), "global": (15, 200), "ratings_ip": (10, 60), "ratings_global": (30, 500), "mail": (5, 40), "admin": (60, 2000)}
DAY, MINUTE = 86_400, 60


class SlidingLimit:
    """Times accepted in the last day; a request is let through while both counts are below their limits."""

    def __init__(self, per_min: int, per_day: int, times=()):
        self.per_min, self.per_day, self.times = per_min, per_day, deque(times)

    def admit(self, t: float) -> bool:
        while self.times and self.times[0] < t - DAY:
            self.times.popleft()
        if len(self.times) >= self.per_day or sum(1 for x in self.times if x > t - MINUTE) >= self.per_min:
            return False
        self.times.append(t)
        return True


def admit_requests(df: DataFrame, key: str, per_min: int, per_day: int) -> DataFrame:
    """Adds admitted to (key, ts, seq): a sliding limiter per key in which denied requests don't count.

    The decision depends on all earlier ones of the key, so a key's requests are one fold, with at most per_day times
    held at once; rows come in batches in order of time, so a frequent key costs time and no memory.
    """
    kind = df.schema[key].dataType.simpleString()

    def of(batches):
        limit, current, started = None, None, False
        for batch in batches:
            admitted = []
            for k, t in zip(batch["key"], batch["t"]):
                if not started or not (k == current or (pd.isna(k) and pd.isna(current))):
                    limit, current, started = SlidingLimit(per_min, per_day), k, True
                admitted.append(limit.admit(t))
            yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "admitted": admitted})

    rows = df.select(F.col(key).alias("key"), "seq", F.unix_micros("ts").alias("us")).withColumn("t", F.col("us") / 1e6)
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "us", "seq").select("key", "seq", "t")
    return sorted_rows.mapInPandas(of, f"key {kind}, seq long, admitted boolean").withColumnRenamed("key", key)


def rate_counts(df: DataFrame, key: str, per_min: int, per_day: int) -> DataFrame:
    """Adds in_minute and in_day, the key's requests up to each one, and whether each limit would be exceeded."""
    us = F.unix_micros("ts")
    at = Window.partitionBy(key).orderBy("us")
    rows = df.withColumn("us", us).withColumns({"in_minute": F.count(F.lit(1)).over(at.rangeBetween(-59_999_999, 0)), "in_day": F.count(F.lit(1)).over(at.rangeBetween(-DAY * 1_000_000, 0))})
    return rows.withColumns({"over_minute": F.col("in_minute") > per_min, "over_day": F.col("in_day") > per_day}).drop("us")


def fold_cooldown(rows, until: float | None, seconds: int):
    """rows (t, outcome, correction) of one address in order; gives accepted for each, and the time it is blocked until.

    A first mail starts a block, to whose last moment others are refused; a complete failure or a refusal by the global limit ends it, a partial failure keeps
    it, and a correction renews it.
    """
    accepted = []
    for t, outcome, correction in rows:
        if not correction and until is not None and t <= until:
            accepted.append(False)
            continue
        accepted.append(outcome != "limit")
        if outcome in ("failed", "limit"):
            until = until if correction else None
        else:
            until = t + seconds
    return accepted, until


def address_cooldown(df: DataFrame, seconds: int = 600) -> DataFrame:
    """Adds accepted to mails (email, ts, seq, outcome, correction): ok, failed, partial or limit; addresses without
    regard to case."""

    def of(batches):
        current, until = None, None
        for batch in batches:
            accepted = []
            for k, *row in zip(batch["address"], batch["t"], batch["outcome"], batch["correction"]):
                if k != current:
                    current, until = k, None
                (one,), until = fold_cooldown([row], until, seconds)
                accepted.append(one)
            yield pd.DataFrame({"seq": batch["seq"], "accepted": accepted})

    rows = df.filter("email is not null").select(F.lower("email").alias("address"), "seq", (F.unix_micros("ts") / 1e6).alias("t"), "outcome", F.coalesce("correction", F.lit(False)).alias("correction"))
    done = rows.repartition("address").sortWithinPartitions("address", "t", "seq").mapInPandas(of, "seq long, accepted boolean")
    return df.join(done, "seq", "left")


def fold_tickets(rows, owner: str | None, is_open: bool):
    """rows (address, outcome, correction) of one ticket in order; gives allowed for each (None where it is no correction),
    and whose ticket it is then and whether it is open."""
    allowed = []
    for address, outcome, correction in rows:
        if not correction:
            if outcome in ("ok", "partial"):
                owner, is_open = address, True
            allowed.append(None)
            continue
        good = is_open and address == owner
        allowed.append(good)
        if good and outcome == "ok":
            is_open = False
    return allowed, owner, is_open


def correction_tickets(df: DataFrame) -> DataFrame:
    """Adds allowed to corrections in (ticket, email, ts, seq, outcome, correction).

    A ticket is issued by a mail that went out, for its address. It allows one correction, from the same address;
    a correction that fails, if only in part, leaves it open.
    """

    def of(batches):
        current, owner, is_open = None, None, False
        for batch in batches:
            allowed = []
            for k, *row in zip(batch["ticket"], batch["address"], batch["outcome"], batch["correction"]):
                if k != current:
                    current, owner, is_open = k, None, False
                (one,), owner, is_open = fold_tickets([row], owner, is_open)
                allowed.append(one)
            yield pd.DataFrame({"seq": batch["seq"], "allowed": pd.array(allowed, dtype="boolean")})

    rows = df.filter("ticket is not null").select("ticket", F.lower("email").alias("address"), "seq", (F.unix_micros("ts") / 1e6).alias("t"), "outcome", F.coalesce("correction", F.lit(False)).alias("correction"))
    done = rows.repartition("ticket").sortWithinPartitions("ticket", "t", "seq").mapInPandas(of, "seq long, allowed boolean")
    return df.join(done, "seq", "left")
