"""Every registered query of the library against DuckDB, and rules, streams and edge cases by hand."""

import math
import os

import duckdb
import pytest

from convlake.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (bool, int)):
        return str(int(v))
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in order]).collect())
    rel = duck.sql(ORACLES[name])
    want = sorted(tuple(map(plain, r)) for r in rel.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall())
    assert sorted(rel.columns) == order and got == want


def test_prices_at_the_edges(spark):
    from pyspark.sql import functions as F

    from convlake import pricing as P

    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("a😀", P.utf16_len) == 3
    assert one("", P.density_tokens) == 0
    assert one("a" * 88 + "=" * 12, P.density_tokens) == math.ceil(100 / 2.9)  # 12% is not over 12%
    assert one("a" * 87 + "=" * 13, P.density_tokens) == math.ceil(100 / 2.3)
    assert one("😀" * 130 + "x" * 1900, P.density_tokens) == math.ceil(2160 / 2.3)  # 260 of the first 2000 units are dense
    assert one("talk ```code``` talk", P.salience) == pytest.approx(1 - 0.8 * 4 / 20)
    assert one(" https://a.b/c\t\nhello", P.salience) == pytest.approx(max(0.2, 1 - 0.8 * 13 / 21))
    assert one("<thinking>never closed", P.strip_thinking) == ""
    assert [one(x, lambda c: P.round_half_up(c.cast("double"))) for x in ("12.5", "13.5", "-0.5")] == [13, 14, 0]


def test_chunks_wait_for_a_tool_result(spark):
    from convlake.chunking import close_chunks

    rows = [("s", i, 50, i == 1, False) for i in range(6)]
    df = spark.createDataFrame(rows, "session_id string, id long, tokens long, tool_use boolean, tool_result boolean")
    assert [(r["first"], r["last"], r.raw) for r in sorted(close_chunks(df, 100, 2).collect(), key=lambda r: r.chunk_id)] == [(0, 2, 150), (3, 4, 100)]


def test_stream_closes_the_same_chunks(spark, tmp_path):
    import random

    from convlake import chunking, streaming

    draw = random.Random(6)
    schema = "session_id string, id long, tokens long, tool_use boolean"
    rows = [(f"s{k}", i, draw.randint(0, 60), draw.random() < 0.2) for k in range(6) for i in range(draw.randint(1, 40))]
    for part in range(4):
        some = [r for r in rows if part * 10 <= r[1] < part * 10 + 10] + ([r for r in rows if r[1] == 3] if part == 2 else [])
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = streaming.close_chunks(stream, 100, 3).writeStream.format("memory").queryName("closed").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("closed")
    got = {tuple(r)[:5] for r in out.where("not late").collect()}
    assert {(r.session_id, r["first"]) for r in out.where("late").collect()} == {(s, i) for s, i, _, _ in rows if i == 3 and any(x[0] == s and x[1] >= 20 for x in rows)} | {(s, 3) for s, i, _, _ in rows if i == 3}
    batch = chunking.close_chunks(spark.createDataFrame(rows, schema), 100, 3)
    assert got == {tuple(r) for r in batch.select("session_id", "chunk_id", "first", "last", "raw").collect()}


def test_read_log_lets_a_torn_tail_go(spark, tmp_path):
    from convlake.sources import read_log_tolerant

    (tmp_path / "log.jsonl").write_text('{"session_id":"s","id":0,"text":"a"}\n\n{"session_id":"s","id":1,"text":"b"}\n{"session_id":"s","i')
    assert sorted(r.id for r in read_log_tolerant(spark, str(tmp_path / "log.jsonl")).collect()) == [0, 1]
    (tmp_path / "bad.jsonl").write_text('{"session_id":"s","id":0}\n{"sess\n{"session_id":"s","id":1}\n')
    with pytest.raises(ValueError, match="broken line before its end"):
        read_log_tolerant(spark, str(tmp_path / "bad.jsonl"))


def test_layers_are_read_apart(spark, tmp_path):
    from convlake.sources import layers, write_layers

    rows = spark.createDataFrame([("s", level, i) for level in (0, 1, 2) for i in range(4 - level)], "session_id string, level int, id long")
    write_layers(rows, f"{tmp_path}/layers")
    one = layers(spark, f"{tmp_path}/layers", 1)
    assert sorted(r.id for r in one.collect()) == [0, 1, 2] and "PartitionFilters: [isnotnull(level" in one._jdf.queryExecution().toString()


def test_calibration_by_hand(spark):
    from convlake.ledger import calibrate

    rows = [("s", 0, 100.0, None), ("s", 1, None, 150.0), ("s", 2, None, 999.0), ("s", 3, 100.0, None), ("s", 4, None, 0.0), ("s", 5, None, 50.0), ("s", 6, 100.0, None), ("s", 7, None, 140.0), ("s", 8, 10.0, None), ("s", 9, 100.0, None), ("s", 10, None, 80.0)]
    got = calibrate(spark.createDataFrame(rows, "session_id string, id long, armed double, reported double")).first()
    m = 1.0
    for r in (1.5, 1.4, 0.8):  # the second report of a compile, an empty one and a ratio of 0.5 teach nothing
        m = m + 0.2 * (r * m - m)
    assert got.samples == 3 and got.multiplier == pytest.approx(m)


def test_policy_by_hand(spark):
    from convlake.ledger import ledger, policy, stalled

    fail = lambda t, reasons: [(t, i, "fail", r) for i, r in enumerate(reasons)]
    rows = fail("a", ["refusal"] * 9) + fail("b", ["refusal"]) + fail("c", ["provider_error"] * 11) + fail("d", ["provider_error"] * 12) + fail("e", ["empty", "overflow"]) + fail("f", ["stale"]) + fail("g", ["truncated"] * 3 + ["provider_error"])
    led = ledger(spark.createDataFrame(rows, "target string, id long, kind string, reason string"))
    want = {"a": "terminal", "b": "retry", "c": "transient", "d": "transient", "e": "shrink", "f": "none", "g": "transient"}
    assert {r.target: r.action for r in policy(led).collect()} == want
    assert {r.target for r in stalled(led).collect()} == {"a", "d", "g"}


def test_blocked_by_hand(spark):
    from convlake.plans import blocked

    tries = [("a", 0, "L1:0", "retry", 9), ("a", 1, "L1:0", "retry", 10), ("a", 2, "L1:1", "retry", 10), ("a", 3, "L1:0", "retry", 10), ("b", 0, "L1:0", "retry", 4), ("b", 1, "L1:1", "refusal", 4)]
    lengths = [("a", 10), ("b", 9)]
    got = blocked(spark.createDataFrame(tries, "session_id string, id long, target string, outcome string, messages long"), spark.createDataFrame(lengths, "session_id string, messages long"), 2)
    assert {(r.session_id, r.target): r.blocked for r in got.collect()} == {("a", "L1:0"): True, ("a", "L1:1"): False, ("b", "L1:0"): True, ("b", "L1:1"): True}


def test_memories_cost_a_third_or_what_they_took(spark):
    from pyspark.sql import functions as F

    from convlake.pricing import written_tokens

    rows = spark.createDataFrame([("x" * 30, None), ("x" * 31, 0), ("x" * 30, 7)], "t string, o long")
    assert [r[0] for r in rows.select(written_tokens(F.col("t"), F.col("o"))).collect()] == [10, 11, 7]


def test_quiet_chunks_are_text_alone(spark):
    from convlake.pyramid import quiet_stub

    log = spark.createDataFrame([("s", 0, " hi ", True), ("s", 1, "yo", True), ("s", 2, "a", True), ("s", 3, "", False)], "session_id string, id long, text string, text_only boolean")
    chunks = spark.createDataFrame([("s", 0, 0, 1), ("s", 1, 2, 3)], "session_id string, chunk_id long, first long, last long")
    assert [(r.chunk_id, r.chars) for r in quiet_stub(log, chunks, 10).collect()] == [(0, 4)]


def test_forks_of_forks(spark):
    from convlake.sources import resolve_forks

    n = 120  # a chain: each fork shares its parent's records through message 2 * k
    forks = [(f"s{k + 1}", f"s{k}", 2 * k) for k in range(n)]
    log = [(f"s{k}", i, "u") for k in range(n + 1) for i in range(2 * k - 1, 2 * k + 3) if i >= 0]
    got = resolve_forks(spark.createDataFrame(log, "session_id string, id long, participant string"), spark.createDataFrame(forks, "session_id string, parent_id string, at long"))
    seen = {(r.session_id, r.owner, r.id) for r in got.where("session_id in ('s0', 's7', 's120')").collect()}
    parent = {a: (b, c) for a, b, c in forks}
    want = set()
    for s in ("s0", "s7", "s120"):
        at, cut = s, 10**9
        while at:
            want |= {(s, at, i) for owner, i, _ in log if owner == at and i <= cut}
            up = parent.get(at)
            at, cut = (up[0], min(cut, up[1])) if up else (None, cut)
    assert seen == want


def test_entry_point_imports_everything(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_tasks_and_exchanges_are_read(spark, tmp_path):
    from convlake.requests import read_exchanges, read_tasks

    (tmp_path / "b/todo").mkdir(parents=True)
    (tmp_path / "b/todo/02-fix-it.md").write_text("---\ntitle: 'Fix'\nowner: none\n---\nDo it.\n\n## Comments\n- **ann**: one\n  more\n- **bob**: two\n")
    (tmp_path / "b/todo/10-name-only.md").write_text("Only text")
    a, b = sorted(read_tasks(spark, str(tmp_path / "b")).collect(), key=lambda r: r.number)
    assert (a.board, a.column, a.number, a.title, a.owner, a.description) == ("b", "todo", 2, "Fix", None, "Do it.")
    assert [tuple(c) for c in a.comments] == [("ann", "one\nmore"), ("bob", "two")]
    assert (b.title, b.description, b.comments) == ("name only", "Only text", [])
    (tmp_path / "x.jsonl").write_text('{"id":1,"status":200}\n{"id":2,"status":500}\n{"id":3,"failure":"reset"}\n')
    assert [r.failed for r in read_exchanges(spark, str(tmp_path / "x.jsonl")).orderBy("id").collect()] == [False, True, True]


def run_stream(spark, tmp_path, make, parts, schema, mode, name):
    """Files one by one through ``make``, into a table in memory."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    q = make(stream).writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-ck").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_stream_calibrates_as_the_batch_does(spark, tmp_path):
    import random

    from convlake import ledger, streaming

    draw = random.Random(3)
    schema = "session_id string, id long, armed double, reported double"
    parts = [[(f"s{k}", i, draw.uniform(50, 150) if draw.random() < 0.4 else None, None) for k in range(4) for i in range(p * 10, p * 10 + 10)] for p in range(3)]
    parts = [[(s, i, a, None if a else draw.choice([0.0, draw.uniform(30, 250)])) for s, i, a, _ in rows] for rows in parts]
    got = {}
    for r in run_stream(spark, tmp_path, streaming.calibrate, parts, schema, "update", "calibrated"):
        if r.session_id not in got or r.samples >= got[r.session_id][1]:
            got[r.session_id] = (r.multiplier, r.samples)
    want = ledger.calibrate(spark.createDataFrame([r for p in parts for r in p], schema)).collect()
    assert {r.session_id: (pytest.approx(r.multiplier), r.samples) for r in want} == {s: v for s, v in got.items() if v[1]}


def test_stream_limits_posts(spark, tmp_path):
    import datetime
    import random

    from convlake import streaming

    draw, start = random.Random(5), datetime.datetime(2024, 1, 1)
    schema = "channel string, session_id long, event_id long, at timestamp, cap long"
    posts = sorted((start + datetime.timedelta(minutes=draw.randint(0, 5_000)), i) for i in range(120))
    rows = [("c", i % 3, i, at, 4) for at, i in posts]
    got = run_stream(spark, tmp_path, streaming.rate_limit, [rows[k : k + 40] for k in (0, 40, 80)], schema, "append", "limited")
    made, want = {}, {}
    for _, who, i, at, cap in rows:
        kept = [t for t in made.get(who, []) if t >= at - datetime.timedelta(days=1)]
        want[i] = len(kept) < cap
        made[who] = kept + [at] * want[i]
    assert {r.event_id: r.accepted for r in got} == want and not all(want.values())


def test_stream_forms_the_same_memories(spark, tmp_path):
    from convlake import pyramid, streaming
    from convlake.plans import count_edges

    schema = "session_id string, chunk_id long, first long, last long, raw long, text string"
    rows = [(f"s{s}", c, 2 * c, 2 * c + 1, 50, f"chunk {c} of {s} " * 30) for s in range(3) for c in range(4 + 3 * s)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = streaming.due_work(stream, f"{tmp_path}/out", 0, 2)
    q.processAllAvailable()
    q.stop()
    log = spark.createDataFrame([(s, i, text) for s, c, a, b, _, text in rows for i in (a, b)], "session_id string, id long, text string").where("id % 2 = 0")
    batch = pyramid.merge_by_count(pyramid.mint_l1(log, spark.createDataFrame([(s, c, a, a) for s, c, a, *_ in rows], "session_id string, chunk_id long, first long, last long")), 2)
    have = spark.read.parquet(f"{tmp_path}/out/memories")
    key = lambda r: (r.session_id, r.level, r.id, r.text, r.tokens)
    assert sorted(map(key, have.collect())) == sorted(map(key, batch.collect()))
    assert count_edges(have, 2).where("level = 3").count() > 0


def brute_pairs(entries, ahead=6):
    """Entries of (participant, blocks of (type, call, text)) as repaired, one by one."""
    out, uses = [], []
    for i, (who, blocks) in enumerate(entries):
        seen, keep = [], []
        for b in blocks:
            if b[0] != "tool_result" or b[1] in uses and b[1] not in seen:
                keep.append(b)
                seen += [b[1]] * (b[0] == "tool_result")
        if len(keep) < len(blocks) and not keep:
            keep = [("text", None, "[tool call omitted]")]
        lost = [u for u in uses if u not in seen]
        moved = [next((b for _, later in entries[i + 1 : i + 1 + ahead] for b in later if b[:2] == ("tool_result", u)), ("tool_result", u, "?")) for u in lost]
        if lost and not seen:
            out.append(("user", moved))
            moved = []
        out.append((who, moved + keep))
        uses = list(dict.fromkeys(b[1] for b in blocks if b[0] == "tool_use"))
    return out + ([("user", [("tool_result", u, "?") for u in uses])] if uses else [])


def test_tools_are_paired_as_one_by_one(spark):
    import random

    from convlake.repair import STUB, pair_tools

    draw, rows, want = random.Random(1), [], {}
    for s in range(40):
        calls, entries = 0, []
        for _ in range(draw.randint(1, 14)):
            blocks = []
            for _ in range(draw.randint(1, 3)):
                if (x := draw.random()) < 0.4:
                    blocks.append(("tool_use", f"c{calls}", None))
                    calls += 1
                elif x < 0.85:
                    blocks.append(("tool_result", f"c{draw.randint(max(0, calls - 4), calls + 1)}", f"r{draw.randint(0, 99)}"))
                else:
                    blocks.append(("text", None, "hi"))
            entries.append((draw.choice(["user", "agent"]), blocks))
        want[f"s{s}"] = [(who, [(k, c, STUB if x == "?" else x) for k, c, x in blocks]) for who, blocks in brute_pairs(entries)]
        rows += [(f"s{s}", 10 * i, p, who, *b) for i, (who, blocks) in enumerate(entries) for p, b in enumerate(blocks)]
    got = {}
    for r in sorted(pair_tools(spark.createDataFrame(rows, "session_id string, id long, pos int, participant string, type string, call string, text string")).collect(), key=lambda r: (r.session_id, r.id, r.pos)):
        entries = got.setdefault(r.session_id, {})
        entries.setdefault(r.id, (r.participant, []))[1].append((r.type, r.call, r.text))
    assert {s: list(e.values()) for s, e in got.items()} == want


def test_transcripts_are_aligned(spark):
    from convlake.repair import align_transcript

    log = [("a", 0, False, None, "start"), ("a", 1, True, "call:1", None), ("a", 2, False, "result:1", None), ("a", 3, True, None, "bye"), ("b", 0, True, None, "x"), ("c", 0, False, None, "late\nword")]
    sent = [("a", 0, False, [], ["sys"], True, False), ("a", 1, False, [], ["start"], False, False), ("a", 2, True, ["call:1"], [], False, False), ("a", 3, False, ["result:1"], [], False, True), ("a", 4, True, [], ["bye"], False, False),
            ("b", 0, False, [], ["x"], False, False), ("c", 0, False, [], ["q"], False, False), ("c", 1, False, [], ["The user said:\nlate\nword"], True, False)]
    got = align_transcript(spark.createDataFrame(log, "session_id string, id long, assistant boolean, key string, text string"), spark.createDataFrame(sent, "session_id string, at long, assistant boolean, keys array<string>, texts array<string>, system boolean, results boolean"))
    assert {r.session_id: (r.matched, r.start) for r in got.collect()} == {"a": (1, 1), "c": (1, 0)}
    tail = align_transcript(spark.createDataFrame(log[2:3], "session_id string, id long, assistant boolean, key string, text string"), spark.createDataFrame(sent, "session_id string, at long, assistant boolean, keys array<string>, texts array<string>, system boolean, results boolean"))
    assert [(r.matched, r.start) for r in tail.collect()] == [(3, 2)]


def brute_spans(rows, target, least):
    out, run = [], []
    close = lambda: out.append((run[0][0], run[-1][0], sum(r[2] for r in run), min(r[3] for r in run), None)) or run.clear()
    for r in rows:
        if r[1] > 2 * target:
            if run:
                close()
            n = -(-r[1] // target)
            out += [(r[0], r[0], r[1] // n, r[3], f"g{r[0]}")] * n
            continue
        run.append(r)
        if sum(x[2] for x in run) >= target and len(run) >= least and not r[4]:
            close()
    return out


def test_spans_and_fixed_chunks(spark):
    import random

    from convlake.chunking import fixed_chunks, spans

    draw, rows, logs = random.Random(2), {}, {}
    for s in range(12):
        rows[f"s{s}"] = [(i, n := draw.choice([5, 30, 60, 300]), min(n, 50), draw.random(), draw.random() < 0.3) for i in range(draw.randint(1, 30))]
        logs[f"s{s}"] = [(i, "".join(draw.choices("ab c", k=draw.choice([0, 3, 20, 90])))) for i in range(draw.randint(1, 20))]
    df = spark.createDataFrame([(s, *r) for s, rs in rows.items() for r in rs], "session_id string, id long, tokens long, cut long, salience double, tool_use boolean")
    got = {}
    for r in sorted(spans(df, 100, 3).collect(), key=lambda r: (r.session_id, r.chunk_id)):
        assert r.chunk_id == len(got.setdefault(r.session_id, []))
        got[r.session_id].append(tuple(r)[2:])
    assert got == {s: x for s, rs in rows.items() if (x := brute_spans(rs, 100, 3))}
    texts = fixed_chunks(spark.createDataFrame([(s, *r) for s, rs in logs.items() for r in rs], "session_id string, id long, text string"), 40)
    for s, rs in logs.items():
        mine = sorted((r for r in texts.collect() if r.session_id == s), key=lambda r: r.chunk_id)
        at = (0, 0)
        for r in mine:
            whole = {i: t for i, t in rs}
            ids = [i for i in range(r.start_id, r.end_id + 1) if whole[i]]
            cut = [whole[i][r.start_offset if i == r.start_id else 0 : r.end_offset if i == r.end_id else None] for i in ids]
            assert r.text == "\n".join(cut) and 0 < len(r.text) <= 40 and (r.start_id, r.start_offset) >= at
            at = (r.end_id, r.end_offset)


def test_cuts_against_brute_force(spark):
    import random
    from itertools import groupby

    from convlake import selection as Z

    draw, k, trees = random.Random(7), 2, {}
    for s in range(5):
        n = draw.randint(2, 11)
        raw, nodes = [draw.randint(20, 90) for _ in range(n)], {}
        for c in range(n):
            nodes[1, c] = (draw.randint(5, 25), [c])
        level = 1
        while (m := len([1 for lv, _ in nodes if lv == level]) // k) > 0:
            for i in range(m):
                nodes[level + 1, i] = (draw.randint(5, 25), [i * k, i * k + 1])
            level += 1
        trees[f"s{s}"] = (raw, nodes)
    leaves = lambda nodes, lv, i: [i] if lv == 0 else [x for m in nodes[lv, i][1] for x in leaves(nodes, lv - 1, m)]
    up = {s: {(c, lv): i for lv, i in nodes for c in leaves(nodes, lv, i)} for s, (_, nodes) in trees.items()}

    def project(s, cut):
        moved = True
        while moved:
            moved = False
            for c in sorted(cut, key=lambda c: -cut[c]):
                lv, at = cut[c], up[s].get((c, cut[c]))
                if lv > 0 and (at is None or any(cut[x] != lv for x in leaves(trees[s][1], lv, at))):
                    cut[c], moved = lv - 1, True
        return cut

    def units(s, cut):
        raw, nodes = trees[s]
        names = [(("m", cut[c], up[s][c, cut[c]]), nodes[cut[c], up[s][c, cut[c]]][0]) if cut[c] else (("c", c), raw[c]) for c in range(len(raw))]
        return [x for x, _ in groupby(names)]

    def cost(before, after):
        same = next((i for i, (a, b) in enumerate(zip(before, after, strict=False)) if a[0] != b[0]), min(len(before), len(after)))
        return sum(t for _, t in after[same:])

    chunks = spark.createDataFrame([(s, c, x) for s, (raw, _) in trees.items() for c, x in enumerate(raw)], "session_id string, chunk_id long, raw long")
    memories = spark.createDataFrame([(s, lv, i, t) for s, (_, nodes) in trees.items() for (lv, i), (t, _) in nodes.items()], "session_id string, level int, id long, tokens long")
    edges = spark.createDataFrame([(s, lv, i, m) for s, (_, nodes) in trees.items() for (lv, i), (_, ms) in nodes.items() for m in ms], "session_id string, level int, id long, member long")
    wild = {s: {c: draw.randint(0, 4) for c in range(len(raw))} for s, (raw, _) in trees.items()}
    frame = lambda cuts: spark.createDataFrame([(s, c, lv) for s, cut in cuts.items() for c, lv in cut.items()], "session_id string, chunk_id long, level int")
    back = lambda df: {s: {c: lv for s2, c, lv in rows if s2 == s} for rows in [[tuple(r) for r in df.select("session_id", "chunk_id", "level").collect()]] for s in trees}
    valid = {s: project(s, dict(cut)) for s, cut in wild.items()}
    assert back(Z.project(frame(wild), edges)) == valid

    ideal = {s: project(s, dict.fromkeys(cut, 4)) for s, cut in wild.items()}
    assert back(Z.project(frame({s: dict.fromkeys(cut, 4) for s, cut in wild.items()}), edges)) == ideal
    want = {}
    for s, now in valid.items():
        changes = [c for c in now if now[c] != ideal[s][c]]
        at = lambda i, s=s, now=now, changes=changes: project(s, {c: ideal[s][c] if i < len(changes) and c >= changes[i] else now[c] for c in now})
        low, high = 0, len(changes)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if cost(units(s, now), units(s, at(mid))) <= 60 else (mid + 1, high)
        want[s] = at(low)
    assert back(Z.suffix_adopt(frame(valid), frame(ideal), chunks, memories, edges, 60)) == want

    window, target, want = 400, 230, set()
    shown = {s: {(lv, up[s][c, lv]) for c, lv in ideal[s].items() if lv} for s in trees}
    for s, (raw, nodes) in trees.items():
        cut = dict(ideal[s])
        total = sum(t for _, t in units(s, cut))
        for lv in range(max(x for x, _ in nodes), 0, -1):
            for i in dict.fromkeys(up[s][c, lv] for c in sorted(cut, reverse=True) if cut[c] == lv):
                trial = cut | dict.fromkeys(leaves(nodes, lv, i), lv - 1)
                t = sum(x for _, x in units(s, trial))
                if total < target and t <= window and abs(t - target) < abs(total - target):
                    cut, total = trial, t
                    want.add((s, lv, i))
    tops = spark.createDataFrame([(s, lv, i) for s, x in shown.items() for lv, i in x], "session_id string, level int, id long")
    got = Z.refine(tops, chunks, memories.withColumn("first", memories["id"]), edges, window, target)
    assert {tuple(r) for r in got.select("session_id", "level", "id").collect()} == want and want


def test_logs_grow_by_append(spark, tmp_path):
    from convlake.sources import append, read_log

    path = f"{tmp_path}/log"
    for part in ([("a", 1, "u", "x"), ("a", 2, "u", "y"), ("b", 1, "u", "z")], [("a", 3, "u", "w"), ("c", 1, "u", "v")]):
        append(path, spark.createDataFrame(part, "session_id string, at long, participant string, text string"), "at", 4)
    got = spark.read.parquet(path)
    assert sorted((r.session_id, r.id, r.text) for r in got.collect()) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "w"), ("b", 0, "z"), ("c", 0, "v")]
    (tmp_path / "l.jsonl").write_text('{"session_id":"s","id":0,"text":"a"}\n\n{"session_id":"s","id":1}\n')
    assert sorted((r.id, r.text) for r in read_log(spark, str(tmp_path / "l.jsonl")).collect()) == [(0, "a"), (1, None)]


def test_a_message_that_comes_again_counts_once(spark, tmp_path):
    import datetime

    from convlake.streaming import dedupe_append

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    parts = [[("s", 0, at(0)), ("s", 1, at(1))], [("s", 1, at(1)), ("s", 2, at(2)), ("t", 1, at(2))], [("s", 2, at(2))]]
    got = run_stream(spark, tmp_path, dedupe_append, parts, "session_id string, id long, at timestamp", "append", "once")
    assert sorted((r.session_id, r.id) for r in got) == [("s", 0), ("s", 1), ("s", 2), ("t", 1)]
