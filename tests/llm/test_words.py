"""Operators 11 to 13 against brute force: odd rows, long texts, small tiles, small blocks and a cache that is used again."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, word string, n long, form string, row long, fragments string, text_sha256 string, least long, side int"


def rows_of(seed=5, n=150):
    draw = random.Random(seed)
    stems = ["".join(draw.choices("abcdé", k=draw.randint(4, 8))) for _ in range(40)]

    def word():
        w = draw.choice(stems)
        if draw.random() < 0.3:
            i = draw.randrange(len(w))
            w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("abcdé") + w[i:], w[:i] + draw.choice("abcdé") + w[i + 1 :]])
        return w.upper() if draw.random() < 0.1 else w

    out = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(0, 80))]
        if i % 4 == 0 and words:
            p, at = draw.randint(1, 6), draw.randrange(len(words))
            words[at:at] = [words[at + k % p] if at + k % p < len(words) else "x" for k in range(p * draw.randint(2, 9) + draw.randint(0, 2))]
        out.append((i, draw.choice([" ", "\t", "\n\x0b "]).join(words)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "na " * 500), (n + 4, " ".join(draw.choices(stems, k=9_000))), (n + 5, "Abé-cdéa×÷ab÷ 日本 abcde abcde ÀÉÖßß"), (None, "abcde abcde abcdé " * 3), (None, "abcde abcde abcdé " * 3), (7, out[7][1]), (8, out[8][1] + " more"), (n + 6, "q" * 30_000 + " " + "q" * 30_001)]
    out += [(n + 7 + k, "q" * 30_000 + " <s> </s> <unk> ▁x \x00 \U0001f600") for k in range(3)]
    return [(i, t, "en", "w", 1, "f", 2, "x", "y", 3, 0) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11


def vocabulary(rows):
    count = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) != 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :]


def forms(count):
    near = {w: [v for v in count if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    root = {}
    for w in count:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {w: (count[w], len(near[w]), form[w], count[form[w]] if form[w] else None, root[w]) for w in count}


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_spelling_variants(docs, empty, block):
    from convlake.llm.spelling_variants import spelling_variants

    want = forms(vocabulary(rows_of()))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(docs, block=block).collect()}
    assert got == want and sum(w[2] is not None for w in want.values()) > 20 and any(len(w) > 1000 for w in want)
    assert not spelling_variants(empty).collect()


def test_near_words_meet_in_every_block(spark):
    """A half that most words share is split over a grid; every pair comes once."""
    from convlake.llm.spelling_variants import near_words

    draw = random.Random(3)
    words = sorted({"abcdef" + "".join(draw.choices("gh", k=draw.randint(0, 6))) for _ in range(150)} | {"".join(draw.choices("ab", k=draw.randint(2, 7))) for _ in range(100)})
    df = spark.createDataFrame([(w, 1 + k % 5) for k, w in enumerate(words)], "word string, n long")
    got = Counter((r.word, r.near, r.near_n) for r in near_words(df, pairs=True, block=8).collect())
    assert got == Counter((a, b, 1 + k % 5) for a in words for k, b in enumerate(words) if one_apart(a, b))


# --- 12


def planted(words, doc):
    if doc is None or not words or (h := zlib.crc32(str(doc).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs_of(words):
    found, code = {}, {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([code[w] for w in words])
    for q in range(1, len(words) // 4 + 1):
        same = np.r_[False, ids[:-q] == ids[q:], False]
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted((a, length, q) for (a, length), q in found.items())


@pytest.mark.parametrize("tile", [1 << 16, 64])
def test_periodic_runs(docs, empty, tile):
    from convlake.llm.periodic_runs import periodic_runs

    want = Counter()
    for doc, text, *_ in rows_of():
        words = planted([w for w in re.split("[\x20\x09-\x0d]+", text or "") if w], doc)
        runs = runs_of(words)
        gone = {i for a, length, q in runs for i in range(a + q, a + length)}
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        said = "".join(f"{a},{length},{q}\n" for a, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[doc, len(runs), *top, top[2] and 1000 * top[1] // top[2], sha(said), sha(" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    got = periodic_runs(docs, tile=tile)
    assert Counter(map(tuple, got.collect())) == want and sum(w[1] > 0 for w in want) > 20
    assert not periodic_runs(empty).collect()


def test_document_runs(spark):
    from convlake.llm.periodic_runs import document_runs

    got = document_runs(spark.createDataFrame([(1, "x " + "a b " * 5 + "a"), (2, "a b c")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 11, 2)]


def test_fragments_of_small_tiles():
    from convlake.llm.periodic_runs import fragments_of, joined

    draw = random.Random(1)
    for _ in range(600):
        n, letters = draw.randint(6, 150), draw.choice([1, 2, 3, 50])
        w = [draw.randrange(letters) for _ in range(n)]
        for _ in range(draw.randint(0, 3)):
            a, p = draw.randrange(n), draw.randint(1, max(1, n // 4))
            for i in range(a, min(n, a + p * draw.randint(3, 9))):
                w[i] = w[a + (i - a) % p]
        for tile in (8, 32, 1 << 16):
            found = joined(list(fragments_of(np.array(w), tile)))
            assert sorted((a, b - a + q, q) for q, a, b in found if b - a + q >= max(6, 4 * q)) == runs_of(w)


# --- 13


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, docs, empty, name, monkeypatch):
    import public_tokenizers

    from convlake.llm import token_counts as tc

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = Counter((i, len((t or "").encode()), n := count(t or ""), n > 500) for i, t, *_ in rows_of())
    cache = tc.TokenCache(spark, f"cache_{name.split('.')[-1]}")
    spent = []
    monkeypatch.setattr(tc, "_encoded", lambda texts, p, real=tc._encoded: spent.append(texts.count()) or real(texts, p))
    for limit in (tc.MISSING_ROWS, 0):
        monkeypatch.setattr(tc, "MISSING_ROWS", limit)
        half = docs.where("doc_id % 2 = 0")
        assert tc.token_counts(half, path, 500, cache).count() == half.count()
        for _ in range(2):  # the second time all are known
            assert Counter(tuple(r)[:4] for r in tc.token_counts(docs, path, 500, cache).collect()) == want
        cache = tc.TokenCache(spark, f"other_{name.split('.')[-1]}")
    texts = {t or "" for _, t, *_ in rows_of()}
    even = {t or "" for i, t, *_ in rows_of() if i is not None and i % 2 == 0}
    assert spent == [len(even), len(texts - even)] * 2
    assert not tc.token_counts(empty, path).collect()


def test_queries_equal_their_sql(spark):
    import duckdb

    from convlake.llm import queries

    some = [(i, t) for i, t, *_ in rows_of(9, 60) if i is not None and len(t or "") < 5_000]
    some = list({i: (i, t) for i, t in some}.values())
    df = spark.createDataFrame(some, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    for name, made in (("op11_spelling_variants", queries.spelling_variants(df)), ("op12_periodic_runs", queries.periodic_runs(df))):
        found = con.sql(queries.llm_oracle_sql()[name])
        assert Counter(map(tuple, made.select(*found.columns).collect())) == Counter(found.fetchall()), name
