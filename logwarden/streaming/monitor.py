"""The monitor (T1-T8): checks new lines batch by batch, and what is due without lines.

`foreachBatch` runs the same operators as a batch job against the state the batches
before have left. Every version says which batch of each writer it holds, so a batch that
runs again after it was written does nothing; one that broke off is not seen and starts
anew. `tick` does what time brings about when the log is quiet: blocks run out, the feed is
due, the rule template has changed. Steps take turns, those of other programs that
follow other logs into the same folder included.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden import schemas
from logwarden.operators import firewall
from logwarden.operators.feed import save_feed_meta, sync_due, sync_failed
from logwarden.plans.log_check import Config, check_lines, sync_feed
from logwarden.schemas import STATE_COLUMNS
from logwarden.settings import Settings
from logwarden.sources.sinks import write_report_outbox
from logwarden.sources.snapshot import current_version, load_table, write_state, written_batches
from logwarden.stage import make_folder, owner, remove_folder, written
from logwarden.streaming.store import state_before, state_of, write_changes
from logwarden.streaming.turn import LostTurn, Turn

LINES = "log_group string, seq bigint, ts bigint, line string"


@dataclass(frozen=True)
class Monitor:
    """``config`` is asked before every step, so changed rules apply from the next one on;
    ``feed`` gives the feed table, or ``fetch`` gets a new one when the settings' interval
    is over; ``listing`` is what the firewall itself lists; ``clock`` gives the time of a
    batch's decisions (by default the latest time in the batch). Programs that write to one
    folder each have a ``name``; one that is silent for ``lease`` seconds loses its turn."""

    folder: str
    config: Callable[[SparkSession], Config]
    feed: Callable[[SparkSession], DataFrame] | None = None
    clock: Callable[[], int] | None = None
    fetch: Callable[[SparkSession], DataFrame] | None = None
    listing: Callable[[SparkSession], DataFrame] | None = None
    name: str = "monitor"
    lease: float = 900
    thread: threading.Lock = field(default_factory=threading.Lock, repr=False, compare=False)

    def check(self, lines: DataFrame, batch: int) -> None:
        """One batch: state changes, reports and firewall commands are written down."""
        spark, as_of = lines.sparkSession, self.clock() if self.clock else None
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # a new checkpoint counts from 0 again
        writer = f"{self.name}/{stream}" if stream else self.name

        def work(turn: Turn) -> None:
            if written_batches(spark, f"{self.folder}/state").get(writer, -1) < batch:
                self._check(lines, turn, as_of, {writer: batch})

        self._in_turn(spark, work)

    def tick(self, spark: SparkSession, as_of: int) -> None:
        """What is due at ``as_of`` whether or not there are new lines."""

        def work(turn: Turn) -> None:
            self._migrate_template(spark, turn)
            if self.fetch:
                self._sync(spark, turn, as_of)
            self._check(spark.createDataFrame([], LINES), turn, as_of, {})

        self._in_turn(spark, work)

    def reconcile(self, spark: SparkSession, as_of: int) -> None:
        """At the start: the firewall's own listing decides which addresses have a rule;
        missing rules are added, those no longer due are removed."""

        def work(turn: Turn) -> None:
            settings, before = self.config(spark).settings, self.state(spark)
            parsed = firewall.parse_rules(self.listing(spark), settings.rule_template)
            unmarked = before.withColumn("has_rule", F.lit(False))
            fed = self._feed(spark).withColumn("has_rule", F.lit(False))
            planned = written(firewall.firewall_plan(unmarked, fed, parsed, settings, as_of))
            after = firewall.apply_plan(unmarked, planned).select(*STATE_COLUMNS)
            self._write(spark, turn, after, planned.filter("action in ('ADD', 'REMOVE')"))

        self._in_turn(spark, work)

    def _in_turn(self, spark: SparkSession, work: Callable[[Turn], None]) -> None:
        """Do ``work`` alone; again, from the state as it is then, if the turn was lost meanwhile."""
        while True:
            with self.thread, owner(), Turn(spark, self.folder, self.lease) as turn:
                try:
                    return work(turn)
                except LostTurn:
                    continue

    def _next(self, spark: SparkSession) -> int:
        return (current_version(spark, f"{self.folder}/state") or 0) + 1

    def _check(self, lines: DataFrame, turn: Turn, as_of: int | None, batches: dict[str, int]) -> None:
        spark = lines.sparkSession
        before = partial(state_of, spark, f"{self.folder}/state")
        result = check_lines(lines, before, self._feed(spark), self.config(spark), as_of)
        self._write(spark, turn, result.changes, result.plan, result.reports, batches)

    def _write(
        self, spark: SparkSession, turn: Turn, changes: DataFrame, plan: DataFrame,
        reports: DataFrame | None = None, batches: dict[str, int] | None = None,
    ) -> None:
        """Reports and commands, then the state, which makes the step count. Where there are
        none, nothing is written, and what a broken-off step left there goes."""
        version = self._next(spark)
        commands = plan.select("ip", "ip_version", "action", "command")
        for name, table in (("outbox", reports), ("plan", commands)):
            turn.check()
            if table is None or table.isEmpty():
                remove_folder(spark, f"{self.folder}/{name}/batch={version}")
            else:
                write_report_outbox(table, f"{self.folder}/{name}", version)
        folder = f"{self.folder}/state"
        done = {**written_batches(spark, folder), **(batches or {})}
        write_changes(spark, folder, version, written(changes), done, turn.check)

    def _feed(self, spark: SparkSession) -> DataFrame:
        if self.feed:
            return self.feed(spark)
        last = current_version(spark, f"{self.folder}/feed")
        if last is None:
            return spark.createDataFrame([], schemas.FEED)
        return load_table(spark, f"{self.folder}/feed", last, "feed")

    def _sync(self, spark: SparkSession, turn: Turn, as_of: int) -> None:
        """Fetch the feed when it is due; after a failure again a little later."""
        folder, settings = f"{self.folder}/feed", self.config(spark).settings
        last = current_version(spark, folder)
        meta = save_feed_meta(spark, 0, 0) if last is None else load_table(spark, folder, last, "feed_meta")
        if not meta.select(sync_due(settings.feed_interval, as_of)).first()[0]:
            return
        old, version = self._feed(spark), (last or 0) + 1
        try:
            new = written(self.fetch(spark))
        except Exception as error:  # noqa: BLE001 - whatever the service does, checking goes on
            print(f"feed not fetched: {error}")
            late = sync_failed(meta) if last is not None else save_feed_meta(spark, as_of - settings.feed_interval + 300, 0)
            write_state(folder, version, feed=written(old), feed_meta=written(late))
            return
        before = self.state(spark)
        after, plan, _ = sync_feed(old, new, before, settings, as_of)
        write_state(folder, version, feed=written(after), feed_meta=save_feed_meta(spark, as_of, as_of))
        flips = plan.select("ip", (F.col("action") == "ADD").alias("rule_after"))
        changes = before.join(flips, "ip").withColumn("has_rule", F.col("rule_after")).select(*STATE_COLUMNS)
        self._write(spark, turn, changes, plan)

    def _migrate_template(self, spark: SparkSession, turn: Turn) -> None:
        """Commands that replace every rule of the template used so far."""
        folder, new = f"{self.folder}/template", self.config(spark).settings
        last = current_version(spark, folder)
        if last is not None:
            used = load_table(spark, folder, last, "template").first()
            old = replace(new, rule_template=used["rule_template"], append_rules=used["append_rules"])
            before = self.state(spark)
            commands = template_change(self._listed(spark, before, old), old, new)
            if commands is None:
                return
            self._write(spark, turn, before.limit(0), commands)
        row = spark.createDataFrame([(new.rule_template, new.append_rules)], "rule_template string, append_rules boolean")
        write_state(folder, (last or 0) + 1, template=row)

    def _listed(self, spark: SparkSession, state: DataFrame, settings: Settings) -> DataFrame:
        """The firewall's listing, or as it should be after the commands given so far."""
        if self.listing:
            return self.listing(spark)
        head, tail = firewall.template_parts(settings.rule_template)
        line = F.concat(F.lit(f"-A {firewall.CHAIN} {head}"), "ip", F.lit(tail))
        ruled = state.filter("has_rule").select("ip", "ip_version").union(self._feed(spark).filter("has_rule").select("ip", "ip_version"))
        return ruled.distinct().select("ip_version", line.alias("line"))

    def start(self, lines: DataFrame, every: str | None = None) -> StreamingQuery:
        """Follow a stream of lines, every so many seconds, or until nothing is left."""
        writer = lines.writeStream.foreachBatch(self.check).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def state(self, spark: SparkSession) -> DataFrame:
        return state_before(spark, f"{self.folder}/state")

    def reports(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "outbox", schemas.REPORTS)

    def report_stream(self, spark: SparkSession) -> DataFrame:
        """Reports as they come, for `delivery.Delivery`."""
        return spark.readStream.schema(schemas.REPORTS).parquet(make_folder(spark, f"{self.folder}/outbox"))

    def commands(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "plan", "ip string, ip_version int, action string, command string")

    def _read(self, spark: SparkSession, name: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(make_folder(spark, f"{self.folder}/{name}"))


def template_change(listing: DataFrame, old: Settings, new: Settings) -> DataFrame | None:
    """Commands for a changed rule template, None when it is the same."""
    return None if old.rule_template == new.rule_template else firewall.migrate_rule_template(listing, old, new)
