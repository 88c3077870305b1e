"""Memories that merges form, against one merge at a time."""

import random

import pytest

SCHEMA = "session_id string, level int, id long, first long, last long, text string, tokens long"


def ones(sessions, gaps, seed):
    draw, out = random.Random(seed), {}
    for s in range(sessions):
        at, rows = 0, []
        for i in range(draw.randint(1, 25)):
            at += draw.random() < gaps
            n = draw.randint(1, 3)
            text = " ".join("".join(draw.choices("ab", k=3)) for _ in range(draw.randint(1, 12)))
            rows.append((1, i, at, at + n - 1, text, draw.randint(1, 60)))
            at += n
        out[f"s{s}"] = rows
    return out


def one_at_a_time(rows, due):
    """Memories and edges of a session; ``due`` names the members of the next merge or lift, and the level it goes to."""
    have, edges, taken = list(rows), [(1, r[1], 0, r[1]) for r in rows], set()
    while (found := due([r for r in have if r[:2] not in taken], have)) is not None:
        members, level = found
        members = sorted(members, key=lambda r: (r[2], r[0], r[1]))
        text = " ".join(" ".join(r[4] for r in members).split()[:40])
        node = (level, sum(r[0] == level for r in have), members[0][2], max(r[3] for r in members), text, -(-len(text) // 3))
        have.append(node)
        edges += [(*node[:2], *r[:2]) for r in members]
        taken |= {r[:2] for r in members}
    return have, edges


def runs_of(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if out and r[2] <= out[-1][-1][3] + 1:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def due_by_run(k):
    def due(free, have):
        for level in sorted({r[0] for r in free}):
            live = max(r[3] for r in have if r[0] == level)
            for run in runs_of([r for r in free if r[0] == level]):
                if len(run) >= k:
                    return run[:k], level + 1
                if len(run) >= 2 and run[-1][3] < live:
                    return run, level + 1
        return None

    return due


def due_by_first_run(k, widest):
    def due(free, have):
        for level in sorted({r[0] for r in free}):
            mine = [r for r in free if r[0] == level]
            if len(mine) < k:
                continue
            runs = runs_of([r for r in mine if r[3] - r[2] <= widest * k ** max(0, level - 3)])
            for i, run in enumerate(runs):
                if len(run) >= k or (i < len(runs) - 1 and len(run) >= 2):
                    return run[:k], level + 1
        return None

    return due


def due_by_tokens(least, target, lifts):
    def group(rows):
        for n in range(len(rows)):
            if n + 1 >= least and sum(r[5] for r in rows[: n + 1]) >= target:
                return rows[: n + 1]
        return None

    def due(free, have):
        for level in sorted({r[0] for r in free}):
            if found := group(sorted((r for r in free if r[0] == level), key=lambda r: r[1])):
                return found, level + 1
        if lifts and free:
            top = max(r[0] for r in free)
            if found := group(sorted((r for r in free if r[0] < top), key=lambda r: (r[2], -r[0], r[1]))):
                return found, max(r[0] for r in found) + 1
        return None

    return due


def check(spark, rows, made, due):
    memories, edges = (df.collect() for df in made)
    got = {s: (sorted(tuple(r)[1:] for r in memories if r.session_id == s), sorted(tuple(r)[1:] for r in edges if r.session_id == s)) for s in rows}
    for s, mine in rows.items():
        have, links = one_at_a_time(mine, due)
        assert got[s] == (sorted(have), sorted(links)), s


def frame(spark, rows):
    return spark.createDataFrame([(s, *r) for s, rs in rows.items() for r in rs], SCHEMA)


def test_runs(spark):
    from convlake import forming

    rows = ones(150, 0.15, 1)
    check(spark, rows, forming.form(frame(spark, rows), forming.by_run(3)), due_by_run(3))


def test_first_runs(spark):
    from convlake import forming

    rows = ones(150, 0.15, 2)
    check(spark, rows, forming.form(frame(spark, rows), forming.by_first_run(3, 4)), due_by_first_run(3, 4))


def test_tokens_and_lifts(spark):
    from convlake import forming

    rows = ones(120, 0, 3)
    lifted = [f"s{s}" for s in range(0, 120, 2)]
    made = forming.form_with_lifts(frame(spark, rows), spark.createDataFrame([(s,) for s in lifted], "session_id string"), 2, 40)
    check(spark, {s: r for s, r in rows.items() if s in lifted}, made, due_by_tokens(2, 40, True))
    check(spark, {s: r for s, r in rows.items() if s not in lifted}, made, due_by_tokens(2, 40, False))


def test_nothing_to_form(spark):
    from convlake import forming

    memories, edges = forming.form(spark.createDataFrame([], SCHEMA), forming.by_run(2))
    assert not memories.collect() and not edges.collect()


def test_sql_goes_on_to_the_last_level():
    """F2 to F13: the SQL of merges by tokens ended at level 4, and a longer session has more."""
    import duckdb

    from convlake.forming_queries import TOKENS

    db = duckdb.connect()
    db.sql("CREATE TABLE documents AS SELECT i AS doc_id, 's' AS source, 'en' AS lang, repeat('abcdefg ' || i || ' ', 400) AS text FROM range(600) t(i)")
    levels = dict(db.sql(TOKENS + " SELECT level, count(*) FROM mem GROUP BY 1").fetchall())
    due = db.sql(TOKENS + " SELECT level FROM mem ANTI JOIN edg ON edg.member_level = mem.level AND edg.member = mem.id GROUP BY 1 HAVING count(*) >= 2 AND sum(tokens) >= 250").fetchall()
    assert max(levels) > 4 and due == []


@pytest.fixture(scope="module")
def long_session(spark, tmp_path_factory):
    """A folder with a session of more than four levels and one that ends at level 1; what each rule forms there, once."""
    import duckdb

    from convlake import forming_queries as Q

    home, real, memo = str(tmp_path_factory.mktemp("long")), Q.formed, {}
    duckdb.sql(f"COPY (SELECT i AS doc_id, if(i < 1200, 'long', 'short') AS source, 'en' AS lang, repeat('abcdefg ' || i || ' ', 400) AS text, 4000 AS n_chars FROM range(1201) t(i)) TO '{home}/documents.parquet'")
    patch = pytest.MonkeyPatch()
    patch.setattr(Q, "formed", lambda s, d, kind: memo.get(kind) or memo.setdefault(kind, real(s, d, kind)))
    yield home
    patch.undo()


#: Queries whose SQL ended at level 4, by finding.
LEVELLED = {
    "F2": "k1_layout_of_lifts",
    "F3": "m11_max_level_of_lifts",
    "F4": "m12_source_text_of_lifts",
    "F6": "m4_form_by_tokens_edges",
    "F7": "m5_form_lifted",
    "F8": "m5_form_lifted_edges",
    "F9": "m7_closure_of_lifts",
    "F10": "m7_closure_of_tokens",
    "F11": "m8_members_of_lifts",
    "F12": "m9_chunks_of_lifts",
    "F13": "m9_chunks_of_tokens",
}


@pytest.mark.parametrize("name", LEVELLED.values(), ids=LEVELLED.keys())
def test_queries_and_sql_agree_on_a_long_session(spark, long_session, name):
    import duckdb

    from convlake.queries import ORACLES, QUERIES

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{long_session}/documents.parquet')")
    found = QUERIES[name](spark, long_session)
    want = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in found.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and want


def test_a_lift_above_level_four_reaches_the_layout(spark, tmp_path):
    """F2: SQL of four levels lifted below a fifth level, so the layout had a recall where the query's has raw chunks."""
    import duckdb

    from convlake.forming_queries import TOKENS, tokens_sql
    from convlake.queries import ORACLES, QUERIES

    duckdb.sql(f"COPY (SELECT i AS doc_id, 's' AS source, 'en' AS lang, repeat('abcdefg ' || (i + 1000) || ' ', 400) AS text, 5200 AS n_chars FROM range(112) t(i)) TO '{tmp_path}/documents.parquet'")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    found = QUERIES["k1_layout_of_lifts"](spark, str(tmp_path))
    told = lambda sql: sorted(map(repr, db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in found.columns)} FROM ({sql})").fetchall()))
    got = sorted(map(repr, map(tuple, found.collect())))
    oracle = ORACLES["k1_layout_of_lifts"]
    assert got == told(oracle) and got != told(oracle.replace(TOKENS, tokens_sql(2, 250, 4)))
