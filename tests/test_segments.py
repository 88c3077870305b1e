"""Runs that close by size, in one pass and slice by slice, against a loop."""

import random

import pytest

SCHEMA = "session_id string, id long, tokens long, cut long, salience double, tool_use boolean, text string"


def logs(sessions=1000):
    draw, out = random.Random(4), {}
    for s in range(sessions):
        kind, n = draw.randrange(6), draw.randint(1, 60)
        sizes = {0: [50], 1: [0, 0, 0, 30], 2: [0], 3: range(1, 120), 4: [5, 30, 60, 300, 700], 5: [1]}[kind]
        out[f"s{s}" if s else None] = [(i, t := draw.choice(sizes), min(t, 70), draw.random(), draw.random() < draw.choice([0, 0.3, 0.9]), "".join(draw.choices("ab c", k=draw.choice([0, 3, 20, 90])))) for i in range(n)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s, *r) for s, rs in rows.items() for r in rs], SCHEMA)


def one_by_one(rows, target, least):
    out, held = [], []
    for i, tokens, _, _, call, _ in rows:
        held.append((i, tokens))
        if sum(t for _, t in held) >= target and len(held) >= least and not call:
            out.append((held[0][0], held[-1][0], sum(t for _, t in held)))
            held = []
    return out


def spans_one_by_one(rows, target, least):
    out, held = [], []
    for i, tokens, cut, salience, call, _ in rows:
        if tokens > 2 * target:
            if held:
                out.append((held[0][0], held[-1][0], sum(c for _, c, _ in held), min(x for _, _, x in held), None))
            n = -(-tokens // target)
            out += [(i, i, tokens // n, salience, f"g{i}")] * n
            held = []
            continue
        held.append((i, cut, salience))
        if sum(c for _, c, _ in held) >= target and len(held) >= least and not call:
            out.append((held[0][0], held[-1][0], sum(c for _, c, _ in held), min(x for _, _, x in held), None))
            held = []
    return out


def pieces_one_by_one(rows, size):
    out, held = [], []
    say = lambda ps: "".join(("\n" if k and ps[k - 1][0] != p[0] else "") + p[2] for k, p in enumerate(ps))
    for i, *_, text in rows:
        for offset in range(0, len(text), size):
            piece = (i, offset, text[offset : offset + size])
            if held and len(say([*held, piece])) > size:
                out.append((held[0][0], held[0][1], held[-1][0], held[-1][1] + len(held[-1][2]), say(held)))
                held = []
            held.append(piece)
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id or "", r.chunk_id)):
        assert r.chunk_id == len(out.setdefault(r.session_id, []))
        out[r.session_id].append(tuple(r)[2:])
    return out


def held(found):
    return {s: x for s, x in found.items() if x}


@pytest.mark.parametrize(("size", "target"), [(1 << 16, 100), (8, 100), (8, 700), (1, 60), (8, 0)])
def test_chunks(spark, size, target):
    from convlake.chunking import close_chunks

    rows = logs(1000 if (size, target) == (8, 100) else 150)
    assert collected(close_chunks(frame(spark, rows), target, 3, size)) == held({s: one_by_one(r, target, 3) for s, r in rows.items()})


@pytest.mark.parametrize("size", [1 << 16, 7])
def test_spans(spark, size):
    from convlake.chunking import spans

    rows = logs(200)
    assert collected(spans(frame(spark, rows), 100, 3, size)) == held({s: spans_one_by_one(r, 100, 3) for s, r in rows.items()})


@pytest.mark.parametrize("size", [1 << 16, 5])
def test_fixed_chunks(spark, size):
    from convlake.chunking import fixed_chunks

    rows = logs(200)
    assert collected(fixed_chunks(frame(spark, rows), 40, size)) == held({s: pieces_one_by_one(r, 40) for s, r in rows.items()})


def test_no_log(spark):
    from convlake.chunking import close_chunks, fixed_chunks, spans

    none = spark.createDataFrame([], SCHEMA)
    assert not close_chunks(none, 1, 1).collect() and not spans(none, 1, 1).collect() and not fixed_chunks(none, 1).collect()


def test_a_hot_session_is_spread(spark):
    """A session with most of the rows is solved in slices: no task gets more rows than a slice has."""
    from convlake import chunking

    hot = spark.range(20_000).selectExpr("'hot' AS session_id", "id", "id % 97 AS tokens", "id % 5 = 0 AS tool_use")
    rest = spark.range(10_000).selectExpr("cast(id div 10 as string) AS session_id", "id % 10 AS id", "id % 97 AS tokens", "false AS tool_use")
    dealt = chunking.chunk_of(hot.unionByName(rest), 300, 4, 1000)
    rows = [(i, i % 97, 0, 0, i % 5 == 0, "") for i in range(20_000)]
    got = dealt.where("session_id = 'hot' and not open").groupBy("chunk_id").agg({"id": "min"}).collect()
    assert sorted(r[1] for r in got) == [a for a, _, _ in one_by_one(rows, 300, 4)]
    assert dealt.count() == 30_000
