"""JSON lengths with numbers of any size, and prices after images go, against loops."""

import json
import random
from decimal import Decimal

import pytest


def shown(x):
    """A number as JavaScript writes it."""
    if x == 0:
        return "0"
    sign, digits, power = Decimal(repr(float(x))).normalize().as_tuple()
    text, n = "".join(map(str, digits)), power + len(digits)
    if 0 < n <= 21:
        out = text.ljust(n, "0") if len(text) <= n else f"{text[:n]}.{text[n:]}"
    elif -6 < n <= 0:
        out = "0." + "0" * -n + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return "-" * sign + out


def test_numbers_as_javascript_writes_them(spark):
    from pyspark.sql import functions as F

    from convlake.blocks import json_len

    draw = random.Random(2)
    numbers = ["0", "-0", "-0.0", "0.10", "1e7", "1.0", "1e21", "1e20", "123456789012345678901", "0.000001", "0.0000001", "-1.5e-9", "9007199254740993", "1E+5", "100", "12345678.5", "1.20e3"]
    numbers += [f"{draw.choice(['', '-'])}{draw.randrange(1, 10**6)}e{draw.randrange(-30, 30)}" for _ in range(300)]
    texts = [f'{{"a 1e9 \\" 7": [{x}, "1e9", {x}], "b": {{"c": null, "d": true}}}}' for x in numbers] + ["[]", "3", '"1e7"']
    found = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", json_len(F.col("t")).alias("n")).orderBy("k").collect()]
    rule = [len(f'{{"a 1e9 \\" 7":[{shown(float(x))},"1e9",{shown(float(x))}],"b":{{"c":null,"d":true}}}}') for x in numbers] + [2, 1, 5]
    assert found == rule, [(t, a, b) for t, a, b in zip(texts, found, rule, strict=True) if a != b]
    assert all(json.loads(t) is not ... for t in texts)


def one_by_one(messages, images, depth, count, size):
    out, newer, kept, used = {}, 0, 0, 0
    for i, tokens in sorted(messages, reverse=True):
        left = tokens
        for _, _, raw, more in sorted(x for x in images if x[0] == i):
            if (depth and newer > depth) or (count and kept >= count) or (size and used + more > size):
                left -= max(0, raw - 9)
            else:
                kept, used = kept + 1, used + more
        out[i], newer = left, newer + tokens
    return out


@pytest.mark.parametrize("limits", [(500, 6, 300), (0, 0, 0), (0, 0, 120), (200, 0, 0), (0, 4, 0)])
def test_stripped_prices(spark, limits):
    from convlake.requests import stripped_prices

    draw, messages, images = random.Random(9), {}, {}
    for s in [None, "a", "b", "c"]:
        messages[s] = [(i, draw.randrange(100)) for i in range(20)]
        images[s] = [(i, p, draw.choice([0, 5, 900, 1600]), draw.randrange(80)) for i in range(21) for p in range(draw.randrange(4))]
    m = spark.createDataFrame([(s, *x) for s, xs in messages.items() for x in xs], "session_id string, id long, tokens long")
    p = spark.createDataFrame([(s, *x) for s, xs in images.items() for x in xs], "session_id string, id long, pos long, raw long, bytes long")
    found = {}
    for r in stripped_prices(m, p, *limits).collect():
        found.setdefault(r.session_id, {})[r.id] = r.tokens
    assert found == {s: one_by_one(messages[s], images[s], *limits) for s in messages}
