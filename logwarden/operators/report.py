"""Abuse reports: which hits are reported, how often, and with what text
(J8-J10, P6, P7, W4, F6-F10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.dates import format_epoch
from logwarden.functions.text import mask, render_comment, report_payload, truncate_comment
from logwarden.operators.skew import salted_join
from logwarden.settings import REPORT_GAP_SECONDS, Settings
from logwarden.stage import written

# Report category codes and names.
CATEGORY_NAMES = {
    3: "FraudOrders",
    4: "DDoSAttach",
    5: "FTPBruteForce",
    6: "PingOfDeath",
    7: "Phishing",
    8: "FraudVoIP",
    9: "OpenProxy",
    10: "WebSpam",
    11: "EmailSpam",
    12: "BlogSpam",
    13: "VPNIP",
    14: "PortScan",
    15: "Hacking",
    16: "SQLInjection",
    17: "Spoofing",
    18: "BruteForce",
    19: "BadWebBot",
    20: "ExploitedHost",
    21: "WebAppAttack",
    22: "SSH",
    23: "IoTTargeted",
}

COVER_SECONDS = 3600
BLOCK_SECONDS = 86_400
LONG_AGO = -(1 << 62)
MASK_LIMIT = 10_000


def report_settings(hits: DataFrame, resolved: DataFrame) -> DataFrame:
    """Hits with ``report, categories, comment`` of their rule, as resolved by
    `resolve_report_settings`. The rule table is configuration; it goes into the plan as
    a local table, whose size the planner knows when it decides on a broadcast."""
    keys = ["group_idx" if "group_idx" in hits.columns else "log_group", "kind", "rule_idx"]
    slim = resolved.select(*keys, "report", "categories", "comment")
    known = hits.sparkSession.createDataFrame(slim.collect(), slim.schema)
    return hits.join(known, keys)


def reportable(hits: DataFrame, settings: Settings) -> DataFrame:
    """Hits that may be reported at all: reporting is on, the rule asks for it and
    names at least one category."""
    return hits.filter(F.lit(settings.reporting_enabled) & F.col("report") & (F.size("categories") > 0))


def not_whitelisted(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of addresses that are not on the allow list."""
    listed = state.filter("whitelisted").select("ip")
    counts = rows.groupBy("ip").agg(F.count("*").alias("n"))
    return salted_join(rows, listed, "ip", counts, "left_anti").select(*rows.columns)


def throttle_reports(candidates: DataFrame, state: DataFrame, gap: int = REPORT_GAP_SECONDS, block: int = BLOCK_SECONDS) -> DataFrame:
    """Per address, report the first candidate and then each first one that is at least
    ``gap`` seconds after the last reported; a stored ``last_reported`` counts too.
    Addresses on the allow list are not reported.

    An address's log is cut into blocks of ``block`` seconds (``gap`` or more). What the reports
    before a block mean for it is one number, the time of the last one, and what the block does
    to that number is a short table (:func:`block_functions`), worked out for all blocks side by
    side. Going through an address's tables in order, one row per block, gives the number with
    which each block begins; then the blocks choose their reports, again side by side. So no
    task sees more of an address than one block of seconds, or a row for each of its blocks.
    Only address, time and number of a candidate go through this; the chosen ones are looked up.
    """
    if block < gap:
        raise ValueError("a block is at least as long as the gap")
    first = candidates.filter("ip IS NOT NULL").groupBy("ip", "ts").agg(F.min("seq").alias("seq"))
    # Nothing before a stored report's gap is over can be chosen, so the first block that is left begins free.
    free_from = F.min(F.when(~F.coalesce("whitelisted", F.lit(False)), F.coalesce(F.col("last_reported") + gap, F.lit(gap))))
    limits = state.groupBy("ip").agg(free_from.alias("free_from"), F.lit(True).alias("limited"))
    limits = written(limits.filter(F.col("free_from").isNull() | (F.col("free_from") != gap)))
    if limits.isEmpty():
        free = first.filter(F.col("ts") >= gap)
    else:
        counts = candidates.groupBy("ip").agg(F.count("*").alias("n"))
        free = salted_join(first, limits, "ip", counts).filter(F.col("ts") >= F.when(F.col("limited"), F.col("free_from")).otherwise(gap))
    seconds = written(free.select("ip", F.floor(F.col("ts") / block).alias("block"), "ts", "seq"))
    ordered = seconds.select("ip", "block", "ts").repartition("ip", "block").sortWithinPartitions("ip", "block", "ts")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from block_functions(batches, gap, block)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from last_before(batches, gap, block)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pick_started(batches, gap)

    shapes = ordered.mapInArrow(tables, "ip string, block bigint, since array<bigint>, last array<bigint>")
    begins = shapes.repartition("ip").sortWithinPartitions("ip", "block").mapInArrow(folded, "ip string, block bigint, last_reported bigint")
    # A block's beginning is a row without time before its seconds, so both come in one exchange.
    started = seconds.unionByName(begins, allowMissingColumns=True)
    started = started.repartition("ip", "block").sortWithinPartitions("ip", "block", "ts")
    chosen = started.mapInArrow(emitted, first.schema)
    found = candidates.join(chosen, ["ip", "ts", "seq"], "left_semi").select(*candidates.columns)
    # A line may be a candidate twice; one of them is reported. With seq, rows need not move again.
    return found.groupBy("ip", "ts", "seq").agg(F.min_by(F.struct(*found.columns), "seq").alias("one")).select("one.*")


def block_functions(batches: Iterator[pa.RecordBatch], gap: int, block: int) -> Iterator[pa.RecordBatch]:
    """For each block of seconds (rows ``ip, block, ts``, sorted) what it makes of the time of the
    last report before it: ``since`` and ``last``, in order. Where reports may go on from a time x,
    the first of ``since`` that is x or later gives the block's last report; none, no report.
    Reports may go on within the block's first ``gap`` seconds, so there are at most that many."""
    rest = None
    for batch in chain(batches, [None]):
        parts = [b for b in (rest, batch) if b is not None and b.num_rows]
        if not parts:
            continue
        table = pa.Table.from_batches(parts)
        ips = table.column("ip").combine_chunks()
        ts = table.column("ts").to_numpy()
        number = table.column("block").to_numpy()
        codes = ips.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (number[1:] != number[:-1])])
        if batch is not None:  # the last block may go on in the next batch
            whole = int(starts[-1])
            rest = table.slice(whole).combine_chunks().to_batches()[0]
            starts = starts[:-1]
        else:
            whole, rest = len(ts), None
        if not len(starts):
            continue
        ts, number = ts[:whole], number[:whole]
        ends = np.r_[starts[1:], whole]
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        key = owner * (3 * block) + (ts - number * block)
        after = np.searchsorted(key, key + gap)  # the next report after each, if its block has one
        here = np.arange(whole)
        last = np.where(after < ends[owner], np.minimum(after, whole - 1), here)
        while True:  # twice as far in each step
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        offset = ts - number * block
        entry = (offset < gap) | (here == np.searchsorted(key, owner * (3 * block) + gap))
        at = here[entry]
        same = (owner[at][1:] == owner[at][:-1]) & (last[at][1:] == last[at][:-1])
        at = at[np.r_[~same, True]]  # of equal ones the last stands for all
        lists = np.searchsorted(owner[at], np.arange(len(starts) + 1))
        column = lambda values: pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(values, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [ips.take(pa.array(starts)), pa.array(number[starts]), column(ts[at]), column(ts[last[at]])],
            names=["ip", "block", "since", "last"],
        )


def last_before(batches: Iterator[pa.RecordBatch], gap: int, block: int) -> Iterator[pa.RecordBatch]:
    """Time of the last report before each block, from rows of :func:`block_functions` sorted by
    address and block; long ago where there is none. One number is carried along."""
    open_ip, reported = None, LONG_AGO
    for batch in batches:
        out = []
        bounds = batch.column(2).offsets.to_pylist()
        since, last = (batch.column(k).values.to_numpy() for k in (2, 3))
        for k, ip in enumerate(batch.column(0).to_pylist()):
            if ip != open_ip:
                open_ip, reported = ip, LONG_AGO
            out.append(reported)
            at = bounds[k] + int(np.searchsorted(since[bounds[k]:bounds[k + 1]], reported + gap))
            if at < bounds[k + 1]:
                reported = int(last[at])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["ip", "block", "last_reported"])


def pick_started(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """Rows ``ip, ts, seq`` that :func:`pick_spaced` chooses. Each block's first row has no time but
    ``last_reported``, which holds for the rows after it, those in the next batch included."""
    rows: list[pa.RecordBatch] = []

    def frames() -> Iterator[pd.DataFrame]:
        reported = LONG_AGO
        for batch in batches:
            begins = batch.column("ts").is_null()
            known = np.r_[reported, batch.column("last_reported").filter(begins).to_numpy()]
            begins = begins.to_numpy(zero_copy_only=False)
            reported = known[-1]
            seconds = batch.filter(pa.array(~begins))
            if seconds.num_rows:
                rows.append(seconds)
                frame = seconds.select(["ip", "block", "ts"]).to_pandas()
                yield frame.assign(last_reported=known[np.cumsum(begins)[~begins]])

    for picked in pick_spaced(frames(), gap):
        yield rows.pop().select(["ip", "ts", "seq"]).take(pa.array(picked.index.to_numpy()))


def pick_spaced(batches: Iterator[pd.DataFrame], gap: int) -> Iterator[pd.DataFrame]:
    """Greedy choice over rows sorted by `ip, block, ts`, all blocks of a batch at once;
    one that goes on in the next batch takes its last choice along. The index of what comes out
    is the row's place in its batch."""
    open_key, open_last = None, None
    for batch in batches:
        if not len(batch):
            continue
        ips, numbers, ts = batch["ip"].to_numpy(), batch["block"].to_numpy(), batch["ts"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (ips[1:] != ips[:-1]) | (numbers[1:] != numbers[:-1])])
        ends = np.r_[starts[1:], len(ts)]
        last = batch["last_reported"].to_numpy()[starts].copy()
        if (ips[0], numbers[0]) == open_key:
            last[0] = open_last
        # Position of the first row of the same block at or after a given time.
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        span = int(ts.max()) - int(ts.min()) + 1
        key = owner * span + (ts - ts.min())

        def first_from(groups, when, key=key, span=span, low=int(ts.min())):
            return np.searchsorted(key, groups * span + np.clip(when - low, 0, span))

        groups = np.arange(len(starts))
        at = first_from(groups, last + gap)
        chosen = []
        while len(groups):
            inside = at < ends[groups]
            groups, at = groups[inside], at[inside]
            chosen.append(at)
            last[groups] = ts[at]
            at = first_from(groups, ts[at] + gap)
        open_key, open_last = (ips[-1], numbers[-1]), last[-1]
        rows = np.sort(np.concatenate(chosen))
        yield pd.DataFrame({"ip": ips[rows], "ts": ts[rows]}, index=rows)


def render_reports(emitted: DataFrame, settings: Settings, mask_strings: Column | DataFrame | None = None) -> DataFrame:
    """``ip, ts, categories, comment``: placeholders filled, cut to the limit, masked.
    ``mask_strings``: an array, or a table as from `mask_list`."""
    if isinstance(mask_strings, DataFrame):
        emitted = emitted.withColumn("\x01masks", mask_array(mask_strings))
        mask_strings = F.col("\x01masks")
    comment = truncate_comment(
        render_comment(
            F.col("comment"), F.col("ip"), F.col("port"), F.col("line"), format_epoch("ts", settings.date_format)
        )
    )
    if settings.report_mask and mask_strings is not None:
        comment = mask(comment, mask_strings)
    return emitted.select("ip", "ts", "categories", comment.alias("comment"))


def mark_reported(state: DataFrame, emitted: DataFrame) -> DataFrame:
    """State with the time of the last report of each address."""
    latest = emitted.groupBy("ip").agg(F.max("ts").alias("reported_at"))
    moved = F.coalesce(F.greatest("last_reported", "reported_at"), "last_reported")
    return state.join(latest, "ip", "left").withColumn("last_reported", moved).select(*state.columns)


def with_payload(reports: DataFrame) -> DataFrame:
    return reports.withColumn("payload", report_payload("categories", "comment", "ip"))


def mask_list(hosts: DataFrame) -> DataFrame:
    """``text`` to mask and its ``place``: host names, then their first labels, then addresses
    without zone, so that a whole name goes before a part of it. Input is a table ``host, addr``
    (either may be NULL)."""
    texts = F.array("host", F.substring_index("host", ".", 1), F.substring_index("addr", "%", 1))
    pieces = hosts.select(F.posexplode(texts).alias("place", "text"))
    return pieces.filter("text <> ''").groupBy("text").agg(F.min("place").alias("place"))


def mask_array(masks: DataFrame) -> Column:
    """The texts of `mask_list` in order, as one array for all rows of another table. They are
    one machine's names and addresses: more than ``MASK_LIMIT`` are refused."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    many = F.raise_error(F.lit(f"more than {MASK_LIMIT} texts to mask")).cast("array<string>")
    return masks.agg(F.when(F.count("*") > MASK_LIMIT, many).otherwise(listed)).scalar()


def suppress_rate_limited(reports: DataFrame, responses: DataFrame) -> DataFrame:
    """Drop reports that fall into a pause ordered by the receiver: from a response
    ``ts, retry_after`` until ``retry_after`` seconds later.

    A second is paused if the latest end of a pause so far lies behind it. That is a
    running maximum within the hour, of one row per second, and what earlier hours carry
    over, of one row per hour; however long a pause is, it stays one row.
    """
    ends = responses.filter("retry_after > 0").groupBy("ts").agg((F.col("ts") + F.max("retry_after")).alias("until"))
    seconds = reports.select("ts").distinct().withColumn("until", F.lit(None).cast("bigint"))
    at = ends.unionByName(seconds).groupBy("ts").agg(F.max("until").alias("until"))
    at = at.withColumn("hour", F.floor(F.col("ts") / COVER_SECONDS))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = at.groupBy("hour").agg(F.max("until").alias("latest")).select("hour", F.max("latest").over(before).alias("carried"))
    so_far = Window.partitionBy("hour").orderBy("ts")
    paused = at.withColumn("until", F.max("until").over(so_far)).join(carried, "hour").filter(F.greatest("until", "carried") > F.col("ts"))
    return reports.join(paused.select("ts"), "ts", "left_anti").select(*reports.columns)


def category_names(reports: DataFrame) -> DataFrame:
    """One row per report and category, with the category's name."""
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair])
    return reports.withColumn("category", F.explode("categories")).withColumn(
        "category_name", F.try_element_at(names, F.col("category"))
    )
