import time
import random
import socket

import pytest
from pyspark.sql import functions as F

from logwarden import functions as fn


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def expected_version(ip):
    for family, version in ((socket.AF_INET, 4), (socket.AF_INET6, 6)):
        try:
            socket.inet_pton(family, ip)
            return version
        except OSError:
            pass
    return -1


def expected_v6(ip):
    try:
        return socket.inet_ntop(socket.AF_INET6, socket.inet_pton(socket.AF_INET6, ip))
    except OSError:
        return None


def random_addresses(n, seed=7):
    rng = random.Random(seed)
    out = [
        "::", "::1", "1::", "::ffff:1.2.3.4", "::1.2.3.4", "::0.0.1.2", "2001:DB8::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
        "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:0:0:2:0:0:3:4", "0:0:0:0:0:0:0:0", "::ffff:0:0", "::1:0", "::1:2",
        "fe80::0001:0:0:1", "2001:0DB8:0:0:0:0:0:1F", "1:2:3:4:5:6:7", ":::", "1::2::3", "12345::", "g::1", "::1.2.3.04",
        "1.2.3.4", "01.2.3.4", "1.2.3", "256.1.1.1", "1.2.3.4 ", "", "0.0.0.0", "::ffff:256.1.1.1", "1:2:3:4:5:6:7:8:9",
        "::1.2.3", "1.2.3.4::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::\n",
    ]
    for _ in range(n):
        groups = [rng.choice(["0", "0000", f"{rng.getrandbits(16):x}", f"{rng.getrandbits(16):04X}"]) for _ in range(8)]
        if rng.random() < 0.6:
            a = rng.randint(0, 7)
            b = rng.randint(a, 8)
            text = ":".join(groups[:a]) + "::" + ":".join(groups[b:])
        else:
            text = ":".join(groups[: rng.choice([7, 8, 8, 8, 8, 9])])
        if rng.random() < 0.25:
            text = text.rsplit(":", 2)[0] + f":{rng.randint(0, 260)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}"
        out.append(text)
    return out


def test_addresses_agree_with_the_operating_system(spark):
    ips = random_addresses(3000)
    assert column(spark, ips, fn.ip_version("x")) == [expected_version(i) for i in ips]
    assert column(spark, ips, fn.ip6_format("x")) == [expected_v6(i) for i in ips]


def test_normalize_leaves_v4_text(spark):
    assert column(spark, ["010.1.1.1", "2001:DB8::1"], fn.normalize_ip("x")) == ["010.1.1.1", "2001:db8::1"]


def test_trim(spark):
    values = ["  a b\t\r", " \t ", "", "x", "\n x"]
    assert column(spark, values, fn.trim_left("x")) == ["a b\t\r", " \t ", "", "x", "x"]
    assert column(spark, values, fn.trim_right("x")) == ["  a b", " \t ", "", "x", "\n x"]


def test_format_epoch(spark):
    assert column(spark, [0, 1558368002], fn.format_epoch("x", "%Y-%m-%d %H:%M:%S"), "long") == [
        "1970-01-01 00:00:00", "2019-05-20 16:00:02"]
    for fmt in ("%U %W %V %G %g", "%u %w %e|%k|%l", "%s %C %P", "%c", "%x %X", "%r %Od %Ey", "%", "", "%%Y"):
        times = [0, 951782400, 1104537599, 1230768000, 1293883199, 1735542245, 1325376000 - 86400]
        want = [time.strftime(fmt, time.gmtime(t))[:29] if fmt else "" for t in times]
        assert column(spark, times, fn.format_epoch("x", fmt), "long") == [w.replace("%s", str(t)) for w, t in zip(want, times)], fmt
    assert column(spark, [0], fn.format_epoch("x", "%d/%b/%Y at o'clock %H%%"), "long") == ["01/Jan/1970 at o'clock 00%"]
    assert column(spark, [0], fn.format_epoch("x", "%Y-%m-%dT%H:%M:%S%z and more text"), "long") == [
        "1970-01-01T00:00:00+0000 and more text"[:29]]


def test_offset_times(spark):
    values = ["2019-05-20T17:00:02+01:00", "2019-05-20T11:00:02-05:00", "2019-05-20T16:00:02", "nonsense", None]
    assert column(spark, values, fn.parse_offset_ts("x")) == [1558368002, 1558368002, 1558368002, None, None]


def test_mask(spark):
    text = "host somehost 10.0.0.1; somehost Some 10.0.0.1"
    got = column(spark, [text], fn.mask("x", F.array(F.lit("somehost"), F.lit(""), F.lit("10.0.0.1"))))
    assert got == ["host ******** ********; ******** Some ********"]


def test_render_comment(spark):
    df = spark.sql("select 'n=%d i=%i p=%p m=%m %i' as tpl, '1.2.3.4' as ip, 22 as port, 'line %d' as line")
    args = ["tpl", "ip", "port", "line"]
    got = df.select(fn.render_comment(*[F.col(a) for a in args], F.lit("NOW"))).first()[0]
    assert got == "n=NOW i=1.2.3.4 p=22 m=line %d %i"
    no_port = df.withColumn("port", F.lit(None).cast("int")).withColumn("tpl", F.lit("p=%p m=%m"))
    assert no_port.select(fn.render_comment(*[F.col(a) for a in args], F.lit("NOW"))).first()[0] == "p=%p m=line NOW"


def test_payload_and_truncation(spark):
    df = spark.sql("select array(14, 22) as c, 'a b*~+é/' as t, '1.2.3.4' as ip")
    assert df.select(fn.report_payload("c", "t", "ip")).first()[0] == (
        "categories=14,22&comment=a%20b%2A~%2B%C3%A9%2F&ip=1.2.3.4")
    assert column(spark, ["x" * 1501], F.length(fn.truncate_comment("x"))) == [1500]


def test_headers(spark):
    raw = "HTTP/1.1 429\r\nRetry-After:  120 \r\nX: a:b\r\nX: second\r\n: empty\r\n"
    got = column(spark, [raw], fn.parse_headers("x"))[0]
    assert got == {"Retry-After": "120", "X": "a:b"}
    assert column(spark, [raw, "none"], fn.header_value(fn.parse_headers("x"), "retry-after")) == ["120", None]


@pytest.mark.parametrize(
    "text,expected",
    [("15,21", [15, 21]), (" 15 , 21", [15, 21]), ("15,x,21", [15]), ("", []), ("x", []), ("15,", [15]), ("7abc,9", [7, 9])],
)
def test_categories(spark, text, expected):
    assert column(spark, [text], fn.parse_categories("x")) == [expected]


def test_small_parsers(spark):
    assert column(spark, ["12ab", " 7", "ab", "", None], fn.parse_uint("x")) == [12, 7, 0, 0, 0]
    assert column(spark, ["TRUE", "false", "maybe", None], fn.parse_tristate("x")) == [True, False, None, None]
    assert column(spark, [3, 50, 400], fn.clamp_feed_score("x"), "int") == [25, 50, 100]
    assert column(spark, [3, 400], fn.clamp_confidence("x"), "int") == [3, 100]
    assert column(spark, [[14, 22]], fn.categories_csv("x"), "array<int>") == ["14,22"]


def test_saturating_addition(spark):
    top = 4294967295
    assert column(spark, [top, top - 5, 1], fn.sat_add_u32(F.col("x"), F.lit(10)), "long") == [top, top, 11]


