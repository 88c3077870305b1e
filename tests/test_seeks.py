"""Seeks in a bucketed log against filters of plain rows, and what their plans read."""

import random
import re
import uuid

import pytest

SCHEMA = "session_id string, id long, text string"


def rows():
    draw, out = random.Random(5), [(None, i, f"n{i}") for i in range(20)]
    out += [("hot", i, f"h{i}") for i in range(6000)]
    out += [("gaps", i * i * 40, f"g{i}") for i in range(60)] + [("below", i, "b") for i in range(-700, 300, 7)]
    out += [(f"s{s}", i, f"{s}:{i}") for s in range(40) for i in range(draw.randint(1, 30))]
    return out


@pytest.fixture(scope="module")
def log(spark):
    from convlake.seeks import SeekableLog

    all_ = rows()
    made = SeekableLog(spark, buckets=64)
    for part in (all_[::2], all_[1::2]):
        made.add(spark.createDataFrame(part, SCHEMA))
    return made


def met(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def found(keep):
    return sorted((r for r in rows() if keep(*r)), key=str)


@pytest.mark.parametrize("literals", [64, 0])
def test_get_and_absent(spark, log, monkeypatch, literals):
    from convlake import seeks

    monkeypatch.setattr(seeks, "LITERALS", literals)
    keys = {("hot", 5), ("hot", 5999), ("hot", 6000), (None, 3), (None, 99), ("gaps", 40), ("gaps", 41), ("none", 1), ("below", -700)}
    df = spark.createDataFrame([*keys, ("hot", 5)], "session_id string, id long")
    assert met(log.get(df)) == found(lambda s, i, t: (s, i) in keys)
    assert {tuple(r) for r in log.absent(df).collect()} == keys - {r[:2] for r in rows()}


def test_every_key(spark, log):
    df = spark.createDataFrame([r[:2] for r in rows()], "session_id string, id long")
    assert met(log.get(df)) == found(lambda *_: True)
    assert not log.absent(df).collect()


def test_ranges_give_a_row_once(spark, log):
    wishes = spark.createDataFrame([("hot", 100, 900), ("hot", 500, 1500), ("hot", 9, 2), (None, 0, 4), ("below", -300, -200), ("gone", 0, 9), ("hot", None, 4)], "session_id string, first long, last long")
    want = found(lambda s, i, t: (s == "hot" and 100 <= i <= 1500) or (s is None and i <= 4) or (s == "below" and -300 <= i <= -200))
    assert met(log.ranges(wishes)) == want


@pytest.mark.parametrize("newest", [1, 5, 300])
def test_page(log, newest):
    by = {}
    for r in rows():
        by.setdefault(r[0], []).append(r)
    want = sorted((r for rs in by.values() for r in sorted(rs, key=lambda r: -r[1])[:newest]), key=str)
    assert met(log.page(newest)) == want


def test_nothing(spark):
    from convlake.seeks import SeekableLog

    none = SeekableLog(spark, buckets=4).add(spark.createDataFrame([], SCHEMA))
    keys = spark.createDataFrame([("a", 1)], "session_id string, id long")
    assert not none.get(keys).collect() and not none.page(3).collect() and none.absent(keys).collect() == [("a", 1)]
    assert not none.get(keys.limit(0)).collect()


def scanned(df, name):
    """Rows that the scan of the table gave, once the plan has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    text, found_, todo = plan.toString(), [], [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec" and name in node.toString():
            found_.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return sum(found_), text


@pytest.mark.parametrize("literals", [64, 0])
def test_no_exchange_above_the_log(spark, log, monkeypatch, literals):
    """The log's side of the join has no Exchange, and few keys read less than a tenth of it."""
    from convlake import seeks

    monkeypatch.setattr(seeks, "LITERALS", literals)
    keys = spark.createDataFrame([("hot", 5), (None, 3)], "session_id string, id long")
    read, plan = scanned(log.get(keys), log.name)
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and log.name in line)
    depth = lambda line: len(re.match(r"[\s:+\-*()\d]*", line).group())
    above, seen = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < above:
            above = depth(line)
            seen.append(line)
    assert any("ShuffledHashJoin" in line for line in seen), plan
    assert not any("Exchange" in line for line in seen), plan
    assert not literals or read < len(rows()) / 10


def test_a_name_and_a_path(spark, tmp_path):
    from convlake.seeks import SeekableLog

    name = f"log_{uuid.uuid4().hex}"
    SeekableLog(spark, name, str(tmp_path / "log"), 4).add(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    again = SeekableLog(spark, name, str(tmp_path / "log"), 4).add(spark.createDataFrame([("a", 2, "y")], SCHEMA))
    assert met(again.rows()) == [("a", 1, "x"), ("a", 2, "y")]
