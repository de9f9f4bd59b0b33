"""Log lines, feeds and lists derived from the test tables.

Each event becomes one log line of an address that depends on its user, so every
job below runs over the whole table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.dates import epoch_seconds

GROUPS = ("OpenSSH", "ApacheAccess")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ip(user: Column) -> Column:
    """Address as written in the log: every fifth user has a v6 address in long form."""
    v4 = F.concat(
        F.lit("10."), F.floor(user / 62500).cast("string"), F.lit("."),
        (F.floor(user / 250) % 250).cast("string"), F.lit("."), (user % 250 + 1).cast("string"),
    )
    high, low = F.hex(F.floor((user + 1) / 65536)), F.hex((user + 1) % 65536)
    v6 = F.concat(F.lit("2001:0DB8:0:0:0:0:"), high, F.lit(":"), low)
    return F.when(user % 5 == 0, v6).otherwise(v4)


def clean_ip(user: Column) -> Column:
    """The same address in canonical form."""
    high, low = F.lower(F.hex(F.floor((user + 1) / 65536))), F.lower(F.hex((user + 1) % 65536))
    v6 = F.concat(F.lit("2001:db8::"), F.when(high != "0", F.concat(high, F.lit(":"))).otherwise(""), low)
    return F.when(user % 5 == 0, v6).otherwise(raw_ip(user))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_group, seq, ts, line`` from `events`; seq is the event id."""
    return lines_dealt_out(table(spark, sf_dir, "events"))


def lines_dealt_out(events: DataFrame) -> DataFrame:
    """The lines of a table or stream of events. A file of the test tables cannot be split, so
    rows are dealt out here, before the text is made of them."""
    narrow = events.select("event_id", "ts", "user_id", "event_type")
    return lines_from_events(narrow.repartition(events.sparkSession.sparkContext.defaultParallelism))


def lines_from_events(events: DataFrame) -> DataFrame:
    ident, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ip = raw_ip(user)
    syslog = F.concat(F.lit("Jun  2 11:25:00 somehost sshd["), ident.cast("string"), F.lit("]: "))
    port = F.element_at(F.array(*[F.lit(p) for p in ("22", "80", "443", "8090")]), (ident % 4 + 1).cast("int"))
    invalid_user = F.concat(
        syslog, F.lit("Invalid user u"), user.cast("string"), F.lit(" from "), ip, F.lit(" port "),
        (ident % 60000 + 1024).cast("string"),
    )
    root_login = F.concat(syslog, F.lit("ROOT LOGIN REFUSED FROM "), ip)
    dropped = F.concat(
        F.lit("Aug  3 04:04:33 somehost kernel: [1.2] IPTABLES-DROPPED: IN=e SRC="), ip,
        F.lit(" DST=10.9.9.9 DPT="), port, F.lit(" LEN=1"),
    )
    access = F.concat(
        ip, F.lit(" - - [17/Jun/2016:07:07:07 +0000] \"GET "),
        F.when(kind == "click", "/phpMyAdmin/").otherwise("/index.html"), F.lit(" HTTP/1.1\" 404 1"),
    )
    line = (
        F.when(kind == "error", invalid_user)
        .when(kind == "signup", root_login)
        .when(kind == "purchase", dropped)
        .otherwise(access)
    )
    return events.select(
        F.when(kind.isin("click", "view"), GROUPS[1]).otherwise(GROUPS[0]).alias("log_group"),
        ident.alias("seq"),
        epoch_seconds("ts").alias("ts"),
        line.alias("line"),
    )


AS_OF = 1706659200
GAP_START = 1705300000
TEMPLATE = "-s %i -j DROP"


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, first_ts, last_ts, n`` of every user."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            epoch_seconds(F.min("ts")).alias("first_ts"),
            epoch_seconds(F.max("ts")).alias("last_ts"),
            F.count("*").alias("n"),
        )
    )


def kept_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored state row for every second user, some of them listed by hand."""
    user = F.col("user_id")
    return events_by_user(spark, sf_dir).filter(user % 2 == 0).select(
        clean_ip(user).alias("ip"),
        F.lit(GAP_START).cast("bigint").alias("last_activity"),
        (user * 7919 % 200000).alias("score"),
        (user % 50).alias("activity_count"),
        (user % 7).alias("refused_count"),
        (user % 34 == 0).alias("whitelisted"),
        ((user % 38 == 0) & (user % 34 != 0)).alias("blacklisted"),
        F.when(user % 3 == 0, F.lit(GAP_START) + user).otherwise(0).cast("bigint").alias("last_reported"),
        F.when(user % 5 == 0, 6).otherwise(4).alias("ip_version"),
        (user % 4 == 0).alias("has_rule"),
    )


def feed(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    """Reputation feed out of `customer`: the old one leaves out every third customer,
    the new one every fourth. Some addresses are users of the log."""
    key = F.col("c_custkey")
    chosen = key % 3 != 0 if old else key % 4 != 0
    return table(spark, sf_dir, "customer").filter(chosen).select(
        clean_ip(key * 3).alias("ip"),
        (key % 1000 + (0 if old else 1)).alias("total_reports"),
        (F.lit(25) + key % 76).cast("int").alias("confidence"),
        F.when(key * 3 % 5 == 0, 6).otherwise(4).alias("ip_version"),
        (F.lit(old) & (key % 7 == 0)).alias("has_rule"),
    )


def feed_times(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    """Sync times: the first or the last event."""
    pick = F.min if old else F.max
    return table(spark, sf_dir, "events").agg(
        epoch_seconds(pick("ts")).alias("sync_time"), (epoch_seconds(pick("ts")) - 60).alias("gen_time")
    )


def firewall_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ip_version, line``: a rule for every third user and every fifth supplier, and
    lines that are no such rules."""
    user = F.col("user_id")
    users = events_by_user(spark, sf_dir)
    of_users = users.filter(user % 3 == 0).select(
        F.when(user % 5 == 0, 6).otherwise(4).alias("ip_version"),
        F.concat(
            F.lit("-A INPUT -s "), clean_ip(user), F.when(user % 5 == 0, "/128").otherwise("/32"),
            F.when(user % 7 == 0, " -j ACCEPT").otherwise(" -j DROP"),
        ).alias("line"),
    )
    key = F.col("s_suppkey")
    strangers = table(spark, sf_dir, "supplier").select(
        F.lit(4).alias("ip_version"),
        F.concat(F.lit("-A INPUT -s 192.0.2."), (key % 250 + 1).cast("string"), F.lit("/32 -j DROP")).alias("line"),
    )
    return of_users.unionByName(strangers)
