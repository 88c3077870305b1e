"""What fits a budget, newest first, in one pass and slice by slice, against a loop."""

import random

import numpy as np
import pytest

SCHEMA = "session_id string, id long, pos long, bytes long"


def one_by_one(items, count, size):
    out, used = [], 0
    for i, pos, more in sorted(items, key=lambda x: (-x[0], x[1], max(x[2] or 0, 0))):
        more = max(more or 0, 0)
        if (not count or len(out) < count) and (not size or used + more <= size):
            out.append((i, pos))
            used += more
    return sorted(out)


def sessions(n=120):
    draw, out = random.Random(7), {}
    for s in range(n):
        sizes = [[1], [0], [0, 0, 9], range(1, 50), [1, 2, 4, 8, 16, 32, 64, 128, 1000], [300, 900, 2000], [None, -3, 5]][s % 7]
        out[f"s{s}" if s else None] = [(draw.randint(0, 40), draw.randint(0, 2), draw.choice(sizes)) for _ in range(draw.randint(1, 70))]
    return out


def test_fitting_equals_a_loop():
    from convlake.admission import fitting

    draw = random.Random(3)
    for _ in range(3000):
        sizes = [draw.choice([0, 1, draw.randrange(8), draw.randrange(400), 1 << draw.randrange(40)]) for _ in range(draw.randrange(40))]
        left = want = draw.choice([0, 1, draw.randrange(50), draw.randrange(3000), 1 << 41])
        fits = []
        for more in sizes:
            fits.append(more <= want)
            want -= more if fits[-1] else 0
        found, rest = fitting(np.array(sizes, np.int64), left)
        assert found.tolist() == fits and rest == want


@pytest.mark.parametrize(("rows", "count", "size"), [(1 << 16, 3, 100), (1 << 16, 0, 0), (1, 0, 100), (4, 5, 130), (3, 4, 0), (7, 0, 1), (5, 0, 3000)])
def test_admit(spark, rows, count, size):
    from convlake.admission import admit

    items = sessions()
    df = spark.createDataFrame([(s, *x) for s, xs in items.items() for x in xs], SCHEMA)
    got = {}
    for r in admit(df, count, size, ("pos",), rows).collect():
        got.setdefault(r.session_id, []).append((r.id, r.pos))
    want = {s: one_by_one(x, count, size) for s, x in items.items()}
    assert {s: sorted(x) for s, x in got.items()} == {s: x for s, x in want.items() if x}


def test_merge_join_finds_the_same(spark, monkeypatch):
    from convlake import admission

    df = spark.createDataFrame([("a", i, 0, i * 37 % 101) for i in range(200)], SCHEMA)
    broadcast = sorted(admission.admit(df, 0, 500, (), 10).collect())
    monkeypatch.setattr(admission, "LOOKED_INTO", 0)
    assert sorted(admission.admit(df, 0, 500, (), 10).collect()) == broadcast == sorted(("a", i) for i, _ in one_by_one([(i, 0, i * 37 % 101) for i in range(200)], 0, 500))


def test_nothing_to_admit(spark):
    from convlake.admission import admit

    assert not admit(spark.createDataFrame([], SCHEMA), 3, 10).collect()
    assert admit(spark.createDataFrame([("a", None, 0, 5), ("a", 4, 0, 6)], SCHEMA), 0, 10).collect() == [("a", 4)]


def test_a_long_session_of_images_is_spread(spark):
    """A session of a million images in 16 slices: the items are those of a loop."""
    from convlake.admission import admit

    n, size = 1_000_000, 40_000_000
    hot = spark.range(n).selectExpr("'hot' AS session_id", "id", "0L AS pos", "pmod(xxhash64(id), 5000) AS bytes")
    got = sorted(r.id for r in admit(hot, 0, size).collect())
    rest, want = size, []
    sizes = np.array(hot.select("bytes").toPandas()["bytes"])
    for i in range(n - 1, -1, -1):
        if sizes[i] <= rest:
            rest -= int(sizes[i])
            want.append(i)
    assert got == want[::-1]


def test_ids_far_apart_make_no_session_long(spark, monkeypatch):
    """F14 to F18: sessions of few items were solved slice by slice if their ids were far apart, a group for each."""
    from convlake import admission

    def never(*_):
        raise AssertionError("a short session took the long way")

    monkeypatch.setattr(admission, "_long", never)
    items = [(i * 1_000_003, 0, i * 37 % 101) for i in range(50)]
    df = spark.createDataFrame([("a", *x) for x in items], SCHEMA)
    got = sorted((r.id, r.pos) for r in admission.admit(df, 0, 300, ("pos",)).collect())
    assert got == one_by_one(items, 0, 300)


def test_slices_of_long_sessions_hold_many_ranges_of_ids(spark):
    from pyspark.sql import functions as F

    from convlake import admission

    df = spark.createDataFrame([("a", i * 1000) for i in range(40)], "_s string, id long").withColumn("_r", -F.expr("id div 8"))
    sizes = sorted(r["count"] for r in admission._sliced(df, 8).groupBy("_g").count().collect())
    assert sizes == [8] * 5


#: Queries that took the long way with short sessions of ids far apart, by finding.
FAR_APART = {
    "F15": "w6_stripped_prices",
    "F16": "t8_cap_images",
    "F17": "w5_admit",
    "F18": "w6_post_strip_tokens",
}


@pytest.mark.parametrize("name", FAR_APART.values(), ids=FAR_APART.keys())
def test_queries_stream_short_sessions_of_ids_far_apart(spark, tmp_path, monkeypatch, name):
    import duckdb

    from convlake import admission
    from convlake.queries import ORACLES, QUERIES

    def never(*_):
        raise AssertionError("a short session took the long way")

    monkeypatch.setattr(admission, "_long", never)
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id * 1000003 AS event_id, user_id % 3 AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    found = QUERIES[name](spark, str(tmp_path))
    want = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in found.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and want
