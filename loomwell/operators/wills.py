"""Last wills: transactions that run when their session's deadline passes.

wills: session, deadline, claim_deadline, payload
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arm(wills: DataFrame, armed: DataFrame) -> DataFrame:
    """Upsert: the last of (session, at, deadline, payload) wins; an empty payload disarms."""
    last = armed.groupBy("session").agg(F.max(F.struct("at", "deadline", "payload")).alias("l"))
    new = last.select("session", F.col("l")["deadline"].alias("deadline"), F.lit(0).cast("long").alias("claim_deadline"), F.col("l")["payload"].alias("payload"))
    kept = wills.join(new.select("session"), "session", "left_anti").select("session", "deadline", "claim_deadline", "payload")
    return kept.union(new.filter("payload <> ''"))


def refresh(wills: DataFrame, live: DataFrame, deadline: int) -> DataFrame:
    """Push the deadline of sessions that still live."""
    alive = live.select("session", F.lit(True).alias("alive")).distinct()
    return wills.join(alive, "session", "left").withColumn("deadline", F.when(F.col("alive"), F.lit(deadline)).otherwise(F.col("deadline"))).drop("alive")


def due(wills: DataFrame, now: int) -> DataFrame:
    """Wills past their deadline that nobody holds a claim on."""
    return wills.filter((F.col("deadline") < now) & (F.col("claim_deadline") < now))


def claims(wills: DataFrame, claimers: DataFrame, now: int) -> DataFrame:
    """(session, claimer): the first of (session, claimer, at) to claim each due will."""
    first = claimers.groupBy("session").agg(F.min(F.struct("at", "claimer"))["claimer"].alias("claimer"))
    return due(wills, now).select("session").join(first, "session")


def fire(wills: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(fired, left): due wills, corrupt payloads (not JSON objects) dropped unfired."""
    d = due(wills, now)
    sound = F.try_parse_json("payload").isNotNull() & F.col("payload").startswith("{")
    return d.filter(sound), wills.join(d.select("session"), "session", "left_anti")


def closed(wills: DataFrame, closes: DataFrame, polls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean closes (session): the wills that run at once, the wills still armed, and the polls (poll, session) still parked."""
    gone = closes.select("session").distinct()
    return wills.join(gone, "session", "left_semi"), wills.join(gone, "session", "left_anti"), polls.join(gone, "session", "left_anti")
