import os
import re
import threading
import time

import pytest

from logwarden import Settings, schemas
from logwarden.plans.log_check import Config
from logwarden.sources.files import expand, glob_regex, open_filesystem
from logwarden.streaming import store
from logwarden.streaming.monitor import Monitor
from logwarden.streaming.turn import LostTurn, Turn

HOUR = 3600


def row(ip, last, score, *, white=False, black=False, rule=False):
    return (ip, last, score, 1, 0, white, black, 0, 4, rule)


def test_a_batch_opens_due_and_touched_files_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTS", 16)
    folder = str(tmp_path / "x" / "state")
    rows = [row(f"10.0.{k // 250}.{k % 250}", 1000, k * HOUR, rule=k % 2 == 0) for k in range(1000)]
    rows += [row("w", 1000, 10**6, white=True, rule=True), row("b", 1, 1, black=True, rule=True), row("quiet", 1, 1)]
    store.write_changes(spark, folder, 1, spark.createDataFrame(rows, schemas.STATE))
    asked = spark.createDataFrame([("10.0.3.249",), ("unknown",)], "ip string")
    as_of = 1000 + 4 * HOUR  # those with 0 and 2 hours have run out before, the one with 4 has not
    found = store.state_of(spark, folder, asked, as_of)
    assert {r["ip"] for r in found.collect()} == {"10.0.0.0", "10.0.0.2", "10.0.3.249", "w"}
    wanted = spark.createDataFrame([(x,) for x in ("10.0.0.0", "10.0.0.2", "10.0.3.249", "w", "unknown")], "ip string")
    parts = {r[0] for r in wanted.select(store.part_of()).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN \(([\d,]+)\)", plan)[1]
    assert {int(x) for x in opened.split(",")} == parts and len(parts) < 16
    hours = {int(d.split("=")[1]) for d in os.listdir(f"{folder}/version=1/due") if d.startswith("hour=")}
    assert len(hours) > 400  # of which a batch reads those up to now


def test_changes_count_before_the_full_table(spark, tmp_path):
    folder = str(tmp_path / "state")
    rows = [row(f"10.0.0.{k}", 1000, 100, rule=True) for k in range(50)]
    store.write_changes(spark, folder, 1, spark.createDataFrame(rows, schemas.STATE))
    newer = [row("10.0.0.1", 2000, 10**6, rule=True), row("10.0.0.2", 2000, 5), row("new", 10, 10, rule=True)]
    store.write_changes(spark, folder, 2, spark.createDataFrame(newer, schemas.STATE))
    nobody = spark.createDataFrame([], "ip string")
    found = {r["ip"]: r["last_activity"] for r in store.state_of(spark, folder, nobody, 1101).collect()}
    assert found.pop("new") == 10 and found.pop("10.0.0.2", 2000) == 2000  # was due, and has no rule any more
    assert set(found) - {"10.0.0.1"} == {f"10.0.0.{k}" for k in range(50) if k not in (1, 2)}
    assert found.get("10.0.0.1", 2000) == 2000
    assert store.state_before(spark, folder).count() == 51


def test_turns_of_two_programs(spark, tmp_path):
    folder = str(tmp_path / "run")
    order = []

    def work(name):
        with Turn(spark, folder, 60):
            order.append(name)
            time.sleep(0.5)
            order.append(name)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert order in (list("aabb"), list("bbaa"))


def test_a_lost_turn_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "run")
    with Turn(spark, folder, 60) as gone:
        gone.check()
        with Turn(spark, folder, -1) as other:  # takes over at once
            with pytest.raises(LostTurn):
                gone.check()
            other.check()


def test_a_step_that_lost_its_turn_starts_anew(spark, tmp_path, monkeypatch):
    """What another program wrote meanwhile is in the state from which it starts again."""
    config = lambda session: Config(session.createDataFrame([], schemas.RULES), session.createDataFrame([], schemas.GROUPS), Settings())
    monitor = Monitor(str(tmp_path / "run"), config)
    calls = []
    check = Turn.check

    def losing(turn):
        calls.append(1)
        if len(calls) == 1:
            store.write_changes(spark, f"{monitor.folder}/state", 1, spark.createDataFrame([row("other", 1, 1)], schemas.STATE))
            raise LostTurn
        check(turn)

    monkeypatch.setattr(Turn, "check", losing)
    monitor.tick(spark, 100)
    assert [r["ip"] for r in monitor.state(spark).collect()] == ["other"]
    assert not os.path.exists(f"{monitor.folder}/turn")


@pytest.mark.parametrize(("glob", "fits", "fails"), [
    ("a*.log", ["a.log", "ab.log"], ["a.log.1", "b.log"]), ("x?.{gz,log}", ["x1.gz", "xy.log"], ["x.gz", "x1.txt"]),
    ("[ab]c[!0-9]", ["acx"], ["cc1", "ac1"]), (r"a\*b", ["a*b"], ["axb"]),
])
def test_globs(glob, fits, fails, tmp_path):
    pattern = re.compile(glob_regex(glob))
    assert all(pattern.fullmatch(x) for x in fits) and not any(pattern.fullmatch(x) for x in fails)


def test_expand_for_streams(tmp_path):
    for name in ("a.log", "b.log", ".hidden", "c.txt"):
        (tmp_path / name).write_text("x")
    assert expand(f"{tmp_path}/*.log") == [f"{tmp_path}/a.log", f"{tmp_path}/b.log"]
    assert expand(str(tmp_path)) == [f"{tmp_path}/{n}" for n in ("a.log", "b.log", "c.txt")]
    assert expand(f"{tmp_path}/none") == [f"{tmp_path}/none"]


def test_spellings_of_object_stores():
    assert open_filesystem("dbfs:/logs/a")[1] == "/dbfs/logs/a"
