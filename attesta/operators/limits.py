"""Rate limits as tables: fixed-window counters, admission against cascaded caps, what is left of a budget, retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Caps:
    """Most events per network and hour, per workspace, kind and hour, per hour, and per day (UTC)."""

    network: int = 400
    kinds: tuple[tuple[str, int], ...] = (("stance", 150), ("draft", 120), ("classify", 40), ("recheck", 60))
    hour: int = 1500
    day: int = 4000


def counters(events: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """(keys..., window_start, n): events per fixed window."""
    return events.groupBy(*keys, F.date_trunc(unit, "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def kind_cap(kind: Column, caps: Caps) -> Column:
    """The cap of a kind; one that has none is bound by the others only."""
    out = F.lit(caps.hour)
    for k, n in caps.kinds:
        out = F.when(kind == k, n).otherwise(out)
    return out


def admitted(events: DataFrame, caps: Caps = Caps(), prior: DataFrame | None = None) -> DataFrame:
    """``events`` (event_id, ts, network, workspace_id, kind) with ``refused_by``, the first cap that an event failed.

    An event refused by one cap never reaches the next, so each cap counts the survivors of those before. The first two
    caps are dealt out by their own keys. The caps on everybody's hour and day concern all survivors of an hour or day; a
    place there is found from counts per minute, then within the minute. ``prior`` are events that were decided on before,
    with ``refused_by``: they keep the places that they took.
    """
    order = ["ts", "event_id"]
    hour = F.date_trunc("hour", "ts")
    earlier = lambda keys, reached: None if prior is None else _taken(prior.filter(reached), keys)

    def nth(rows: DataFrame, out: str, name: str, keys: list[str], alive: Column, cap: Column, taken: DataFrame | None) -> DataFrame:
        rows = rows.withColumn("__h", hour)
        place = F.sum(F.when(alive, 1).otherwise(0)).over(W.partitionBy(*keys, "__h").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        if taken is not None:
            rows = rows.join(taken, [*keys, "__h"], "left")
            place = place + F.coalesce("__taken", F.lit(0))
        return rows.withColumn(out, F.when(alive & (place > cap), name)).drop("__h", "__taken")

    passed = lambda *caps_: F.col("refused_by").isNull() | ~F.col("refused_by").isin(*caps_)
    rows = nth(events, "__net", "network", ["network"], F.lit(True), F.lit(caps.network), earlier(["network"], F.lit(True)))
    keys = ["workspace_id", "kind"]
    rows = nth(rows, "__kind", "workspace", keys, F.col("__net").isNull(), kind_cap(F.col("kind"), caps), earlier(keys, passed("network")))
    rows = rows.withColumn("__by", F.coalesce("__net", "__kind"))
    rows = _overall(rows, "hour", caps.hour, None if prior is None else prior.filter(passed("network", "workspace")))
    rows = _overall(rows, "day", caps.day, None if prior is None else prior.filter(passed("network", "workspace", "hour")))
    return rows.withColumn("refused_by", F.col("__by")).drop("__net", "__kind", "__by")


def _taken(prior: DataFrame, keys: list[str]) -> DataFrame:
    return prior.groupBy(*keys, F.date_trunc("hour", "ts").alias("__h")).agg(F.count(F.lit(1)).alias("__taken"))


def _overall(rows: DataFrame, unit: str, cap: int, prior: DataFrame | None = None) -> DataFrame:
    """Marks the survivors beyond the cap of each hour or day as refused by it, in ``__by``; ``prior`` took places before."""
    minute = F.date_trunc("minute", "ts")
    alive = F.when(F.col("__by").isNull(), 1).otherwise(0)
    counts = rows.groupBy(minute.alias("__m")).agg(F.sum(alive).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(F.date_trunc(unit, "__m")).orderBy("__m")) - F.col("__n")
    counts = counts.select("__m", before.alias("__before"))
    if prior is not None:
        taken = prior.groupBy(F.date_trunc(unit, "ts").alias("__u")).agg(F.count(F.lit(1)).alias("__taken"))
        counts = counts.withColumn("__u", F.date_trunc(unit, "__m")).join(taken, "__u", "left").select("__m", (F.col("__before") + F.coalesce("__taken", F.lit(0))).alias("__before"))
    placed = rows.withColumn("__m", minute).withColumn("__i", F.sum(alive).over(W.partitionBy("__m").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)))
    joined = placed.join(counts, "__m")
    over = F.col("__by").isNull() & (F.col("__before") + F.col("__i") > cap)
    return joined.withColumn("__by", F.when(over, unit).otherwise(F.col("__by"))).drop("__m", "__i", "__before")


def remaining(own: Column, hourly: Column, daily: Column, caps: Caps = Caps()) -> Column:
    """What is left of the tightest of three budgets, none below zero; counters may be null."""
    left = lambda cap, used: F.lit(cap) - F.coalesce(used, F.lit(0))
    return F.greatest(F.lit(0), F.least(left(caps.network, own), left(caps.hour, hourly), left(caps.day, daily)))


def idle_sessions(events: DataFrame, key: str, gap: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events without a pause as long as ``gap``."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stale_claims(claims: DataFrame, now: Column, minutes: int = 5, attempts: int = 3) -> DataFrame:
    """Claims (state, claimed_at, attempts) older than so many minutes are pending again, or failed after so many tries."""
    old = (F.col("state") == "claimed") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return claims.withColumn("state", F.when(old & (F.col("attempts") >= attempts), "failed").when(old, "pending").otherwise(F.col("state")))


def retained(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """The rows that are not older than so many hours."""
    return rows.filter(F.col(at) >= now - F.make_dt_interval(hours=F.lit(hours)))


def cascade(survivors: DataFrame, tables: dict[str, DataFrame], key: str = "workspace_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table less the rows whose key is gone, and (table, deleted) counts."""
    kept = {k: t.join(survivors.select(key).distinct(), key, "left_semi") for k, t in tables.items()}
    counts = None
    for k, t in tables.items():
        n = t.join(survivors.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(k).alias("table"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts
