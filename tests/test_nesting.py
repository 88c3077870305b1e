"""Blocks nested to any depth against a recursion over the parsed JSON."""

import json
import math
import random

import pytest

SCHEMA = "session_id string, id long, content string"
PUNCTUATION = set('{}[]":_/=`')


def density(text):
    head = text[:2000]
    return math.ceil(len(text) / (2.3 if sum(c in PUNCTUATION or ord(c) > 126 for c in head) / len(head) > 0.12 else 2.9)) if text else 0


def compact(value):
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def price(b):
    kind = b.get("type") if isinstance(b, dict) else None
    if kind == "text":
        return density(b["text"])
    if kind == "thinking":
        return b["tokenEstimate"] if "tokenEstimate" in b else 600 if b.get("signature") and not b["thinking"] else density(b["thinking"])
    if kind == "tool_use":
        return math.ceil(len(compact(b["input"])) / 2.3) + 20
    if kind == "tool_result":
        return sum(map(price, b["content"])) if isinstance(b["content"], list) else math.ceil(len(b["content"]) / 2.3)
    return b.get("tokenEstimate", 1600) if kind == "image" else 1000 if kind == "document" else 0


def depth(b):
    return 1 + max(map(depth, b["content"]), default=-1) if isinstance(b, dict) and b.get("type") == "tool_result" and isinstance(b["content"], list) else 0


def good(b):
    if not isinstance(b, dict):
        return False
    if b["type"] == "tool_result":
        return "toolUseId" in b and (isinstance(b["content"], str) or all(map(good, b["content"])))
    if b["type"] in ("image", "document"):
        return "source" in b
    return b["type"] in ("text", "thinking") or b["type"] == "tool_use" and isinstance(b["input"], dict)


def size(b):
    if b["type"] == "image":
        return 6400, 6400
    if b["type"] == "text":
        return len(b["text"]), sum(map(len, b["text"].split("```")[1::2]))
    n = len(compact(b["input"])) if b["type"] == "tool_use" else 0
    if b["type"] == "tool_result":
        n = len(b["content"]) if isinstance(b["content"], str) else len(compact(b["content"]))
    return n, n


def made(draw, deep):
    kind = draw.choice(["text", "thinking", "tool_use", "image", "document", "strange", *["tool_result"] * 4])
    words = "".join(draw.choices("ab {}`é", k=draw.randrange(30)))
    if kind == "text":
        return {"type": kind, "text": draw.choice([words, "see ```code``` there"])}
    if kind == "thinking":
        return {"type": kind, "thinking": draw.choice(["", words]), "signature": draw.choice(["", "s"])} | ({"tokenEstimate": 7} if draw.random() < 0.3 else {})
    if kind == "tool_use":
        return {"type": kind, "id": "i", "name": "n", "input": draw.choice([{}, {"a": words, "b": [1, 2.5, None, True]}, [1]])}
    if kind == "image":
        return {"type": kind} | ({"source": {"type": "base64", "mediaType": "image/png", "data": "x" * draw.randrange(1, 9)}} if draw.random() < 0.7 else {}) | ({"tokenEstimate": 12.5} if draw.random() < 0.3 else {})
    if kind == "document":
        return {"type": kind} | ({"source": {"type": "base64", "mediaType": "m", "data": "d"}} if draw.random() < 0.7 else {})
    if kind == "strange":
        return {"type": kind, "text": words}
    return {"type": kind, "content": [made(draw, deep - 1) for _ in range(draw.randrange(4))] if deep and draw.random() < 0.8 else words} | ({"toolUseId": "t"} if draw.random() < 0.8 else {})


@pytest.fixture(scope="module")
def contents():
    draw = random.Random(11)
    return {(f"s{k % 3}" if k % 5 else None, k): [made(draw, 5) for _ in range(draw.randrange(4))] for k in range(300)}


def test_any_depth(spark, contents):
    from convlake.nesting import nested_prices

    df = spark.createDataFrame([(*k, compact(v)) for k, v in contents.items()], SCHEMA)
    found = {(r.session_id, r.id): r for r in nested_prices(df).collect()}
    assert found.keys() == contents.keys() and max(r.depth or 0 for r in found.values()) == 5
    for k, blocks in contents.items():
        r, sizes = found[k], [size(b) if b["type"] != "strange" else (0, 0) for b in blocks]
        whole, apart = sum(s[0] for s in sizes), sum(s[1] for s in sizes)
        assert r.prices == pytest.approx([price(b) for b in blocks]), blocks
        assert r.raw == pytest.approx(sum(r.prices)) and r.cut == 0
        assert r.depth == (max(map(depth, blocks)) if blocks else None)
        assert r.good == sum(map(good, blocks)), blocks
        assert r.text == "\n".join(b["text"] if b["type"] == "text" else "[image]" for b in blocks if b["type"] in ("text", "image"))
        assert r.image_bytes == sum(len(b.get("source", {}).get("data", "")) for b in blocks if b["type"] == "image")
        assert r.salience == pytest.approx(1 if whole <= 0 else max(0.2, 1 - 0.8 * min(1, apart / whole))), blocks


def held(b, levels):
    """A block with what lies below ``levels`` taken out, and how many results that empties."""
    if not isinstance(b, dict) or b.get("type") != "tool_result" or isinstance(b["content"], str):
        return b, 0
    if not levels:
        return b | {"content": []}, int(bool(b["content"]))
    inside = [held(x, levels - 1) for x in b["content"]]
    return b | {"content": [x for x, _ in inside]}, sum(n for _, n in inside)


@pytest.mark.parametrize("levels", [0, 2])
def test_what_is_left_unread_is_counted(spark, contents, levels):
    from convlake.nesting import nested_prices

    df = spark.createDataFrame([(*k, compact(v)) for k, v in contents.items()], SCHEMA)
    for r in nested_prices(df, levels).collect():
        cut = [held(b, levels) for b in contents[r.session_id, r.id]]
        assert r.prices == pytest.approx([price(b) for b, _ in cut]) and r.cut == sum(n for _, n in cut)


def test_odd_content(spark):
    from convlake.nesting import nested_prices

    rows = [("a", 0, None), ("a", 1, ""), ("a", 2, "{"), ("a", 3, "[]"), ("a", 4, '"text"'), ("a", 5, '[5, "x", null, {"type": 5}, {"type": "text", "text": 7}, {"type": "tool_result", "content": []}]')]
    found = {r.id: r for r in nested_prices(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((found[k].raw, found[k].good, found[k].salience, found[k].prices, found[k].depth, found[k].text) == (0, 0, 1, [], None, "") for k in range(5))
    assert found[5].prices == [0] * 6 and found[5].good == 0
    assert not nested_prices(spark.createDataFrame([], SCHEMA)).collect()


def test_salience_opens_no_level(spark, contents, monkeypatch):
    """salience walked every level, and a result's JSON was made and read anew for each place that named it."""
    from pyspark.sql import functions as F

    from convlake import nesting

    df = spark.createDataFrame([(*k, compact(v)) for k, v in contents.items()] + [("odd", 0, None), ("odd", 1, "{"), ("odd", 2, '[5, null, {"type": "tool_use"}, {"type": "tool_result"}, {"type": "tool_result", "content": [1e3, 0.10, "\\\\\\"7"]}]')], SCHEMA)
    want = {(r.session_id, r.id): r.salience for r in nesting.nested_prices(df).select("session_id", "id", "salience").collect()}
    monkeypatch.setattr(nesting, "kept", None)
    assert {(r.session_id, r.id): r.salience for r in nesting.nested_salience(df).collect()} == want
    plan = df.select(nesting.weight(F.parse_json("content")).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("to_json(") == 1
