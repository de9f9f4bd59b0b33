"""Delivery of reports (T5): a second stream over the outbox.

The receiver may order a pause (J9); until it is over, reports are dropped, in this batch and
in the next ones. What became of every report is written down batch by batch, and the marker
of a batch makes it count: a batch that runs again after that sends nothing, and a report that
was delivered once is not sent again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.operators.report import suppress_rate_limited
from logwarden.sources.reputation import parse_report_responses
from logwarden.sources.snapshot import current_version, load_table, write_state
from logwarden.stage import make_folder, owner, written

OUTCOMES = "ip string, ts bigint, outcome string"


@dataclass(frozen=True)
class Delivery:
    """``send`` hands reports (``ip, ts, categories, comment``) over and gives them back with
    the receiver's ``status, headers, body``. A report's ``ts`` is its time throughout."""

    folder: str
    send: Callable[[DataFrame], DataFrame]

    def deliver(self, reports: DataFrame, batch: int) -> None:
        """Outcome of each distinct report of a batch: what `parse_report_responses` says,
        'paused' or 'repeated'."""
        spark, version = reports.sparkSession, batch + 1
        with owner():
            last = current_version(spark, self.folder)
            if last is not None and last >= version:
                return
            until = 0 if last is None else load_table(spark, self.folder, last, "pause").first()["until"]
            fresh = written(reports.groupBy("ip", "ts").agg(F.first("categories").alias("categories"), F.min("comment").alias("comment")))
            # Marks of the same seconds only: files of other times are skipped by their statistics.
            span = fresh.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
            done = self.outcomes(spark).filter(F.col("outcome") == "ok")
            done = done.filter(F.col("ts").between(span.low or 0, span.high or 0)).select("ip", "ts")
            new = fresh.join(done, ["ip", "ts"], "left_anti")
            open_now = new.filter(F.col("ts") >= until)
            answered = written(parse_report_responses(self.send(open_now)).select("ip", "ts", "outcome", "retry_after"))
            pauses = written(effective_pauses(answered))
            sent = _before_pauses(answered, pauses)
            kinds = sent.select("ip", "ts", "outcome").unionByName(
                fresh.join(done, ["ip", "ts"], "left_semi").select("ip", "ts", F.lit("repeated").alias("outcome"))
            )
            rest = fresh.join(kinds, ["ip", "ts"], "left_anti").select("ip", "ts", F.lit("paused").alias("outcome"))
            newest = pauses.agg(F.max(F.col("ts") + F.col("retry_after"))).first()[0] or 0
            pause = spark.createDataFrame([(max(until, newest),)], "until bigint")
            write_state(self.folder, version, delivered=kinds.unionByName(rest), pause=pause)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """``ip, ts, outcome`` of all batches that count."""
        last = current_version(spark, self.folder)
        place = make_folder(spark, f"{self.folder}/none") if last is None else f"{self.folder}/version=*/delivered"
        found = spark.read.schema(OUTCOMES).parquet(place)
        batch = F.regexp_extract("_metadata.file_path", r"/version=(\d+)/delivered/", 1).cast("bigint")
        return found.select("*", batch.alias("version")).filter(F.col("version") <= (last or 0)).drop("version")

    def start(self, reports: DataFrame, every: str | None = None) -> StreamingQuery:
        writer = reports.writeStream.foreachBatch(self.deliver).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def effective_pauses(answered: DataFrame) -> DataFrame:
    """``ts, ip, retry_after`` of the answers that order a pause while none holds. An answer
    within a pause would not have come. Of each second only the first such answer can matter, so
    the ordered pass sees a row per second at most."""
    asked = answered.filter("retry_after > 0").groupBy("ts").agg(F.min(F.struct("ip", "retry_after")).alias("first"))
    firsts = asked.select("ts", "first.ip", "first.retry_after").coalesce(1).sortWithinPartitions("ts")

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        until = 0
        for batch in batches:
            kept = []
            for k, (ts, wait) in enumerate(zip(batch["ts"].tolist(), batch["retry_after"].tolist(), strict=True)):
                if ts >= until:
                    kept.append(k)
                    until = ts + wait
            yield batch.iloc[kept]

    return firsts.mapInPandas(chosen, firsts.schema)


def _before_pauses(answered: DataFrame, pauses: DataFrame) -> DataFrame:
    """Answers of reports that no pause held back: those of other times, and within the second
    in which a pause was ordered those up to the one whose answer ordered it."""
    begun = pauses.select("ts", F.col("ip").alias("by"))
    free = suppress_rate_limited(answered, pauses.select("ts", "retry_after"))
    return free.unionByName(answered.join(begun, "ts").filter("ip <= `by`").drop("by"))
