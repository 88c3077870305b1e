"""Streams over a restart, with ended sessions, late rows and state that stays small."""

import random

PRICED = "session_id string, id long, tokens long, tool_use boolean, ended boolean"
CHUNKS = "session_id string, chunk_id long, first long, last long, raw long, text string"


def feed(spark, path, parts, schema, start=0):
    for k, rows in enumerate(parts, start):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drain(df, path, name, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-ck").start()
    q.processAllAvailable()
    q.stop()
    return q


def test_chunks_over_a_restart(spark, tmp_path):
    from convlake import chunking, streaming

    draw = random.Random(8)
    rows = [(f"s{s}", i, draw.choice([0, 20, 60]), draw.random() < 0.3, None) for s in range(8) for i in range(draw.randint(1, 40))]
    parts = [[r for r in rows if p * 10 <= r[1] < p * 10 + 10] for p in range(4)]
    make = lambda s: streaming.close_chunks(s, 100, 3)
    drain(make(feed(spark, f"{tmp_path}/in", parts[:2], PRICED)), tmp_path, "closed")
    drain(make(feed(spark, f"{tmp_path}/in", [parts[2] + parts[1][:3], parts[3]], PRICED, 2)), tmp_path, "closed")
    out = spark.read.parquet(f"{tmp_path}/closed")
    want = chunking.close_chunks(spark.createDataFrame(rows, PRICED), 100, 3).collect()
    assert sorted(tuple(r)[:5] for r in out.where("not late").collect()) == sorted(map(tuple, want))
    assert sorted((r.session_id, r["first"]) for r in out.where("late").collect()) == sorted(r[:2] for r in parts[1][:3])


def test_an_ended_session_leaves_no_state(spark, tmp_path):
    from convlake import streaming

    one = [("a", i, 50, False, i == 4) for i in range(5)] + [("b", i, 50, False, None) for i in range(5)]
    again = [("a", i, 50, False, None) for i in range(2)] + [("b", i, 50, False, None) for i in range(5, 7)]
    drain(streaming.close_chunks(feed(spark, f"{tmp_path}/in", [one, again], PRICED), 100, 2), tmp_path, "ended")
    got = sorted((r.session_id, r.chunk_id, r["first"], r["last"]) for r in spark.read.parquet(f"{tmp_path}/ended").where("not late").collect())
    assert got == [("a", 0, 0, 1), ("a", 0, 0, 1), ("a", 1, 2, 3), ("b", 0, 0, 1), ("b", 1, 2, 3), ("b", 2, 4, 5)]
    state = spark.read.format("statestore").option("stateVarName", "run").load(f"{tmp_path}/ended-ck")
    assert {r.key.session_id: r.value.n for r in state.collect()} == {"a": 0, "b": 1}


def test_late_reports_count_for_nothing(spark, tmp_path):
    from convlake import ledger, streaming

    schema = "session_id string, id long, armed double, reported double"
    rows = [("s", 0, 100.0, None), ("s", 1, None, 120.0), ("s", 4, 100.0, None), ("s", 5, None, 90.0)]
    drain(streaming.calibrate(feed(spark, f"{tmp_path}/in", [rows, [("s", 2, 100.0, None), ("s", 3, None, 170.0), ("s", 6, 80.0, None)]], schema)), tmp_path, "m")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").collect())
    want = ledger.calibrate(spark.createDataFrame(rows, schema)).first()
    assert got == [("s", want.multiplier, want.samples, 0), ("s", want.multiplier, want.samples, 2)]


def test_memories_read_no_more_as_they_grow(spark, tmp_path):
    """Fifty batches over a restart, one of them twice: the memories of the whole log, and state that holds open groups alone."""
    from convlake import pyramid, streaming

    draw = random.Random(9)
    rows = [(f"s{s}", c, 2 * c, 2 * c + 1, 9, " ".join("".join(draw.choices("abé", k=3)) for _ in range(50))) for s in range(3) for c in range(50)]
    parts = [[r for r in rows if r[1] == c] for c in range(50)]
    make = lambda s: streaming.form_memories(s, 2, 3)
    drain(make(feed(spark, f"{tmp_path}/in", parts[:25], CHUNKS)), tmp_path, "m")
    q = drain(make(feed(spark, f"{tmp_path}/in", [*parts[24:]], CHUNKS, 25)), tmp_path, "m")
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(state) <= 3 * (1 + 2 + 2 * 4)
    ones = spark.createDataFrame([r for r in rows if r[1] < 48], CHUNKS)
    log = ones.selectExpr("session_id", "chunk_id AS id", "text")
    want = pyramid.merge_by_count(pyramid.mint_l1(log, ones.selectExpr("session_id", "chunk_id", "chunk_id AS first", "chunk_id AS last")), 3)
    key = lambda r: (r.session_id, r.level, r.id, r.text, r.tokens)
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/m").collect())) == sorted(map(key, want.collect()))
