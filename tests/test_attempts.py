"""What is asked next and what a turn's end says, one by one."""

import random

REQUEST = "session_id string, pos long, part int, type string, call string, text string, level int, id long"
MEMORIES = "session_id string, level int, id long, first long, last long, text string, tokens long"


def requests(n):
    """Requests of recalls, tool calls and texts, some of them badly paired or blank."""
    draw, out = random.Random(12), {}
    for s in range(n):
        kids = draw.randint(2, 6)
        ones = [(1, i, i, i, draw.choice(["a b", "one", "long text " * 9, "é ", "  "] if draw.random() < 0.15 else ["a b", "one", "long text " * 9, "é"]), 5) for i in range(kids)]
        twos = [(2, i, 2 * i, 2 * i + 1, draw.choice(["sum", "both " * 5]), 5) for i in range(kids // 2)]
        edges = [(1, i, i) for i in range(kids)] + [(2, i, c) for i in range(kids // 2) for c in (2 * i, 2 * i + 1)]
        turns = []
        for level, i, *_, text, _ in [*twos, *ones[2 * len(twos) :]]:
            twice = draw.choice([1] * 9 + [2])
            turns += [[("text", None, f"[CM] Recall memory {level}:{i}.", level, i)], [("text", None, text, level, i)]] * twice
            if draw.random() < 0.2:
                turns.append([("tool_use", f"c{len(turns)}", "{}", None, None)])
                turns.append([("tool_result", f"c{len(turns) - (1 if draw.random() < 0.9 else 2)}", draw.choice(["out", ""]), None, None), ("text", None, draw.choice(["said", "said", " "]), None, None)])
        turns.append([("text", None, "now", None, None)])
        out[f"s{s}"] = (ones + twos, edges, turns, draw.choice([None, 200]), draw.choice([900, 1500, 4000]))
    return out


def variants(memories, edges, turns, provider, budget, most):
    size = lambda ts: sum(len(b[2].encode()) for t in ts for b in t) + 512 + 128 * len(ts)
    text = {m[:2]: m[4] for m in memories}

    def taken(ts):
        return all((b[0] != "text" or b[2].strip()) and (b[0] != "tool_result" or i and any(c[0] == "tool_use" and c[1] == b[1] for c in ts[i - 1])) for i, t in enumerate(ts) for b in t)

    out = []
    for level, i in sorted({b[3:] for t in turns for b in t if (b[3] or 0) > 1}, key=lambda n: -next(m[3] for m in memories if m[:2] == n)):
        at = [k for k, t in enumerate(turns) if t[0][3:] == (level, i)]
        if len(at) != 2:
            continue
        kids = [(level - 1, c) for up, j, c in edges if (up, j) == (level, i)]
        new = turns[: at[0]] + [[("text", None, x, None, None)] for n in kids for x in (f"[CM] Recall memory {n[0]}:{n[1]}.", text[n])] + turns[at[1] + 1 :]
        cost = size(new) if provider is None else provider + max(1, size(new) - size(turns))
        if taken(new) and cost + 100 <= budget and len(out) < most:
            out.append((level, i, size(new), new))
    return out


def test_variants(spark):
    from convlake import requests as R

    some = requests(250)
    request = spark.createDataFrame([(s, p, k, *b) for s, x in some.items() for p, t in enumerate(x[2]) for k, b in enumerate(t)], REQUEST)
    memories = spark.createDataFrame([(s, *m) for s, x in some.items() for m in x[0]], MEMORIES)
    edges = spark.createDataFrame([(s, *e) for s, x in some.items() for e in x[1]], "session_id string, level int, id long, member long")
    budgets = spark.createDataFrame([(s, x[3], 100, x[4]) for s, x in some.items()], "session_id string, provider long, reserve long, budget long")
    found = R.admitted_variants(request, memories, edges, budgets, 2)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.variant):
        got.setdefault(r.session_id, []).append((r.level, r.id, r.bound))
    want = {s: variants(*x, 2) for s, x in some.items()}
    assert got == {s: [v[:3] for v in w] for s, w in want.items() if w} and 50 < len(got) < 240
    said = {}
    for r in sorted(R.variant_requests(request, memories, edges, found).collect(), key=lambda r: (r.variant, r.pos, r.part)):
        said.setdefault((r.session_id, r.variant), []).append((r.pos, r.part, r.type, r.call, r.text))
    assert said == {(s, k): [(p, i, *b[:3]) for p, t in enumerate(v[3]) for i, b in enumerate(t)] for s, w in want.items() for k, v in enumerate(w, 1)}


def test_a_turn_s_end(spark):
    from convlake import requests as R

    calls = [("bash", '{"command": "ls -l\\nrm x"}'), ("bash", '{"command": "' + "y" * 90 + '"}'), ("edit", '{"path": "a/b"}'), ("web_search", '{"query": "q"}'), ("finish", "{}"), ("other", "{}")]
    rows = [("s", 0, 0, 0, "assistant", "text", "first", None, None, None, None), ("s", 0, 1, 0, "assistant", "text", "one", None, None, None, None), ("s", 0, 1, 1, "assistant", "text", "two", None, None, None, None), ("s", 0, 2, 0, "assistant", "text", " ", None, None, None, None)]
    rows += [("s", 0, 3, k, "assistant", "tool_use", None, f"c{k}", n, i, None) for k, (n, i) in enumerate(calls)] + [("s", 0, 4, 0, "user", "tool_result", "no", "c2", None, None, True)]
    rows += [("s", 1, 5, k, "assistant", "tool_use", None, f"d{k}", "other", "{}", None) for k in range(23)] + [("s", 2, 6, 0, "user", "text", "hello", None, None, None, None)]
    df = spark.createDataFrame(rows, "session_id string, turn long, id long, pos long, participant string, type string, text string, call string, name string, input string, failed boolean")
    got = {r.turn: r.text for r in R.turn_ended(df, "Ada").collect()}
    assert got[0] == "one\n\ntwo\n\nWhat Ada ran this turn: $ ls -l · $ " + "y" * 80 + "… · edit a/b (failed) · web_search “q” · other"
    assert got[1] == R.SILENT + "\n\nWhat Ada ran this turn: " + " · ".join(["other"] * 20) + " · and 3 more"
    assert got[2] == R.SILENT


def test_requests_for_memories(spark):
    from convlake import requests as R

    rows = [(1, "src", "pre", None, None), (1, "src", "pre", None, True), (1, "src", "", 900, None), (2, "src", None, None, True), (4, "src", "pre", 900, None)]
    df = spark.createDataFrame(rows, "level int, source string, prefix string, reading_tokens long, source_only boolean")
    got = [(r.scope, r.user) for r in R.memory_requests(df, 200).collect()]
    t = R.TEMPLATES
    marker, l1 = t["marker"], t["l1_chunk"].format(target_tokens=200)
    seen = "your earlier L2 reflections above on portions you read"
    assert got == [
        ("six-section", "\n\n".join(["pre", marker, "src", l1])),
        ("source-only", "\n\n".join([marker, "src", l1])),
        ("six-section", "\n\n".join([marker, "src", t["reading_l1"].format(target_tokens=200, total_tokens=900)])),
        ("prefix+one-level-deeper", "\n\n".join(["src", t["merge"].format(target_tokens=200, target_level=2, seen_description="the slices of recent experience above (raw conversation)")])),
        ("prefix+one-level-deeper", "\n\n".join(["pre", "src", t["reading_merge"].format(target_tokens=200, target_level=4, total_tokens=900, seen_description=seen)])),
    ]


def test_documents_without_a_source_or_with_one_number(spark, tmp_path):
    from convlake import sources

    rows = [(5, "a", "en", "x"), (5, "b", "en", "x"), (5, "b", "en", "x"), (7, "c", "en", None), (None, "d", "en", "x"), (None, None, None, None), (1, "q", "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sources.document_logs(spark, str(tmp_path)).collect()
    assert sorted((r.session_id or "", r.id) for r in got) == [("", 0), ("", 1), *[("x", i) for i in range(5)]]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got) == sorted((d is not None, d or 0, t or "") for d, t, *_ in rows)
    assert {(r.id, r.doc_id) for r in got if r.session_id} == {(0, None), (1, 1), (2, 5), (3, 5), (4, 5)}


def test_forks_that_come_from_themselves(spark):
    import pytest

    from convlake import sources

    ring = spark.createDataFrame([("b", "a", 3), ("a", "b", 2), ("d", "a", 9)], "session_id string, parent_id string, at long")
    with pytest.raises(ValueError, match="come from themselves"):
        sources.ancestors(ring)


def test_a_transcript_of_very_many_lines(spark):
    from convlake.repair import align_transcript

    draw = random.Random(3)
    lines = [draw.choice("abc") for _ in range(100_000)]
    log = [("a", 0, False, None, "\n".join(lines[-40_000:])), ("a", 1, False, None, "\n".join(lines[-5:])), ("a", 2, False, None, "x" + "\n".join(lines[-3:])), ("b", 0, False, None, "late\n")]
    sent = [("a", 0, False, [], ["\n".join(lines), None], False, False), ("a", 1, False, [], ["\n".join(lines[:-1])], False, False), ("a", 2, False, [], ["q", "so\n" + "\n".join(lines[-5:])], False, False), ("b", 0, False, [], ["so\nlate"], False, False), ("b", 1, False, [], ["so\nlate\n"], False, True)]
    got = align_transcript(spark.createDataFrame(log, "session_id string, id long, assistant boolean, key string, text string"), spark.createDataFrame(sent, "session_id string, at long, assistant boolean, keys array<string>, texts array<string>, system boolean, results boolean"))
    assert {r.session_id: (r.matched, r.start) for r in got.collect()} == {"a": (0, 0), "b": (1, 0)}
