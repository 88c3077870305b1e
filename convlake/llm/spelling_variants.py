"""Spelling variants by FM-index search schemes over the delimited vocabulary.

A word that differs from another by one code point agrees with it on its right half, up to its end, or on its left
half, up to its start. So each half is matched exactly, from its delimiter inwards, and the search goes on across
the other half allowing one error: with a backward index of the vocabulary for right halves, and with the index of
its mirror image for left halves. All queries of a block go through the suffix-rank intervals together.

The vocabulary is dealt to blocks by halves, so that words which may be near meet, and a half that very many words
have is split over a grid of blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_checked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the rule: letters, how often one is lost, the shortest and rarest words that count, how much commoner a form is.
RUN = "[A-Za-zÀ-ÿ]+"
LOST = 97
SHORTEST, RAREST, COMMONER = 5, 3, 2
#: A block indexes about half as many words, and never more; it is asked as many at most.
BLOCK = 1 << 16
#: Queries of a block that go through its intervals at once.
ASKED = 1 << 13
#: Blocks of split shards: (side, shard) with their slices are broadcast up to so many.
SHARD_ROWS = 100_000


def vocabulary(docs: DataFrame, lost: int | None = LOST, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n): the maximal runs of letters of all texts, A-Z lower-cased; one in ``lost`` occurrences, by a checksum of
    doc_id and run, loses a code point. A null doc_id is written as nothing. Short and rare ones are left out."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w"))
    runs = runs.where(F.length("w") >= shortest).select("doc_id", F.translate("w", UPPER, LOWER).alias("w"))
    word = F.col("w")
    if lost:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("w")))
        runs = runs.withColumn("h", h)
        word = F.when(F.col("h") % lost == 0, F.expr("overlay(w placing '' from cast(h % length(w) as int) + 1 for 1)")).otherwise(F.col("w"))
    counts = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= rarest)


class BackwardIndex:
    """Suffix ranks of ``words``, each after a delimiter, read as a ring; a step puts a letter before what was matched."""

    def __init__(self, words: Sequence[str]):
        letters = sorted(set("".join(words)))
        self.code = {c: k + 1 for k, c in enumerate(letters)}  # 0: the delimiter
        self.sigma = len(letters) + 1
        text = np.frombuffer(("\n" + "\n".join(words)).encode("utf-32-le"), "<u4")
        table = np.zeros(int(text.max()) + 1, np.int64)
        for c, k in self.code.items():
            table[ord(c)] = k
        codes, self.size = table[text], len(text)
        rank, k, names = codes, 1, self.sigma
        while names < self.size:  # distinct words: no two turns of the ring are equal
            found, rank = np.unique(rank * self.size + np.roll(rank, -k), return_inverse=True)
            names, k = len(found), 2 * k
        places = np.empty(self.size, np.int64)
        places[rank] = np.arange(self.size)
        self.before = codes[places - 1]  # the transform: what stands before each suffix, by rank
        by_letter = np.argsort(self.before, kind="stable")
        self.steps = self.before[by_letter] * self.size + by_letter
        self.owner = (np.cumsum(codes == 0) - 1)[places]

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes that start with ``letter`` and go on with one of low .. high."""
        base = letter * self.size
        return np.searchsorted(self.steps, base + low), np.searchsorted(self.steps, base + high)

    def letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) of the letters that stand before an interval: looked up where it is narrow, else all are tried."""
        width = high - low
        narrow, wide = np.flatnonzero(width <= self.sigma), np.flatnonzero(width > self.sigma)
        total = width[narrow]
        at = np.repeat(low[narrow] - np.r_[0, np.cumsum(total)[:-1]], total) + np.arange(total.sum()) if len(narrow) else np.array([], np.int64)
        seen = np.unique(np.repeat(narrow, total) * self.sigma + self.before[at])
        tried = (wide[:, None] * self.sigma + np.arange(1, self.sigma)[None, :]).ravel()
        both = np.r_[seen[seen % self.sigma > 0], tried]
        return both // self.sigma, both % self.sigma


def one_error(index: BackwardIndex, words: Sequence[str], exact: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``words``, place in the index) of words one error apart whose last ``exact`` letters agree, once each.

    Of a run of equal letters the error is put on the first, so no two ways lead to one pair.
    """
    length = np.array([len(w) for w in words], np.int64)
    flat = np.array([index.code.get(c, -1) for w in words for c in w], np.int64)
    start = np.cumsum(length) - length
    free = length - np.array(exact, np.int64)  # letters before the exact half
    q, p = np.arange(len(words)), length.copy()
    low, high = np.zeros(len(words), np.int64), np.full(len(words), int((index.before == 0).sum()), np.int64)
    err = np.zeros(len(words), bool)
    out_q, out_w = [np.array([], np.int64)], [np.array([], np.int64)]
    while len(q):
        ended = (p == 0) & err
        if ended.any():
            a, b = index.step(np.zeros(int(ended.sum()), np.int64), low[ended], high[ended])
            whole = b > a  # one suffix: words are distinct
            out_q.append(q[ended][whole])
            out_w.append(index.owner[a[whole]])
        plain = np.flatnonzero((p > 0) & (err | (p > free[q])))  # one letter on, as it is
        want = flat[start[q[plain]] + p[plain] - 1]
        plain, want = plain[want > 0], want[want > 0]
        a, b = index.step(want, low[plain], high[plain])
        held = b > a
        new = [(q[plain][held], p[plain][held] - 1, a[held], b[held], err[plain][held])]
        at = np.flatnonzero(~err & (p <= free[q]))
        if len(at):
            mine = np.where(p[at] > 0, flat[np.maximum(start[q[at]] + p[at] - 1, 0)], -2)
            further = np.where(p[at] > 1, flat[np.maximum(start[q[at]] + p[at] - 2, 0)], -2)
            gone = at[(p[at] > 0) & ((mine != further) | (mine < 0) & ~_same(words, q[at], p[at], mine, further))]
            new.append((q[gone], p[gone] - 1, low[gone], high[gone], np.ones(len(gone), bool)))
            state, letter = index.letters(low[at], high[at])
            here = at[state]
            a, b = index.step(letter, low[here], high[here])
            held = b > a
            state, letter, here, a, b = state[held], letter[held], here[held], a[held], b[held]
            same = letter == mine[state]
            moved = p[here] > 0
            for keep, back, wrong in ((moved & same, 1, False), (moved & ~same, 1, True), (~same, 0, True)):
                new.append((q[here][keep], p[here][keep] - back, a[keep], b[keep], np.full(int(keep.sum()), wrong)))
        q, p, low, high, err = (np.concatenate(x) for x in zip(*new, strict=True))
    return np.concatenate(out_q), np.concatenate(out_w)


def _same(words: Sequence[str], q: np.ndarray, p: np.ndarray, mine: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Whether a letter that the index lacks stands twice; other places are false."""
    out = np.zeros(len(q), bool)
    for k in np.flatnonzero((mine == -1) & (further == -1)):
        w = words[q[k]]
        out[k] = w[p[k] - 1] == w[p[k] - 2]
    return out


def _solve(rows: pa.Table, pairs: bool) -> pa.Table:
    """A block's words (kept rows: asked false) and queries: near pairs, or for each query how many and the commonest."""
    side = rows.column("side")[0].as_py()
    asked = np.array(rows.column("asked").to_pylist(), bool)
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    held = sorted({words[k]: counts[k] for k in np.flatnonzero(~asked)}.items())
    queries = [words[k] for k in np.flatnonzero(asked)]
    found_q, found_w = [np.array([], np.int64)], [np.array([], np.int64)]
    if held and queries:
        face = (lambda w: w) if side else (lambda w: w[::-1])
        index = BackwardIndex([face(w) for w, _ in held])
        for at in range(0, len(queries), ASKED):
            some = queries[at : at + ASKED]
            a, b = one_error(index, [face(w) for w in some], [len(w) - len(w) // 2 if side else len(w) // 2 for w in some])
            if not side:  # pairs that agree on the right half too are the other side's
                new = np.array([not held[w][0].endswith(some[q][len(some[q]) // 2 :]) for q, w in zip(a, b, strict=True)], bool)
                a, b = a[new], b[new]
            found_q.append(a + at)
            found_w.append(b)
    q, w = np.concatenate(found_q), np.concatenate(found_w)
    n = np.array([c for _, c in held], np.int64)
    order = np.lexsort((w, -n[w], q)) if len(q) else q
    q, w = q[order], w[order]
    first = np.flatnonzero(np.r_[True, np.diff(q) > 0]) if len(q) else q
    if pairs:
        named = [[queries[k] for k in q], [held[k][0] for k in w], n[w] if len(w) else w]
        return pa.table([pa.array(c, kind) for c, kind in zip(named, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])
    sizes = np.diff(np.r_[first, len(q)])
    best = w[first]
    named = [[queries[k] for k in q[first]], sizes, [held[k][0] for k in best], n[best] if len(best) else best]
    return pa.table([pa.array(c, kind) for c, kind in zip(named, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "near", "near_n"])


def _half(side: int, length: Column) -> Column:
    """The end of a word (side 1) or its start (side 0) that a query of ``length`` letters keeps."""
    word = F.col("word")
    return F.expr("right(word, cast(_len - floor(_len / 2) as int))") if side else F.substring(word, F.lit(1), F.floor(length / 2).cast("int"))


def _blocks(words: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(block, side, asked, word, n): each word as a query of its two halves' blocks, and as an entry where a query of its length
    or one letter more or less may look for it.

    A shard of halves with more than ``block`` entries or queries is a grid: entries by slices, once for each slice of queries.
    """
    shards = max(1, -(-4 * words.count() // block))
    parts = []
    for side in (0, 1):
        for asked, lengths in ((True, F.array(F.length("word"))), (False, F.array(*[F.length("word") + d for d in (-1, 0, 1)]))):
            each = words.select("word", "n", F.explode(lengths).alias("_len")).select("word", "n", _half(side, F.col("_len")).alias("half"))
            each = each if asked else each.distinct()
            parts.append(each.select("word", "n", F.lit(side).alias("side"), F.lit(asked).alias("asked"), F.pmod(F.xxhash64(F.lit(side), "half"), F.lit(shards)).cast("int").alias("shard")))
    dealt = scratch.save(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "dealt")
    sized = dealt.groupBy("side", "shard").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(F.col("asked") == asked) / block)).cast("int").alias(name) for asked, name in ((False, "_e"), (True, "_q"))])
    sized = scratch.save(sized, "shards")
    met = join_checked(dealt, sized, ["side", "shard"], limit=SHARD_ROWS)
    slice_of = lambda c: F.pmod(F.xxhash64("word", F.lit(7)), F.col(c)).cast("int")
    all_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    grid = F.when(F.col("asked"), F.transform(all_of("_e"), lambda e: F.struct(e.alias("e"), slice_of("_q").alias("q")))).otherwise(F.transform(all_of("_q"), lambda q: F.struct(slice_of("_e").alias("e"), q.alias("q"))))
    placed = met.withColumn("_g", F.explode(grid))
    return placed.select(F.xxhash64("side", "shard", "_g.e", "_g.q").alias("block"), "side", "asked", "word", "n")


def near_words(words: DataFrame, pairs: bool = False, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Of a vocabulary (word, n) of distinct words of two letters or more: rows (word, near, near_n) of words exactly one inserted, deleted
    or replaced code point apart, or (word, n_near, near, near_n), the commonest of them, for words that have one."""
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    rows = _blocks(words, scratch, block)
    n_blocks = max(1, -(-8 * words.count() // block))
    fields = "word string, near string, near_n long" if pairs else "word string, n_near long, near string, near_n long"
    found = rows.repartition(n_blocks, "block").groupBy("block").applyInArrow(lambda table: _solve(table, pairs), fields)
    if pairs:
        return found
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    return scratch.save(found, "near").groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.w").alias("near"), (-F.col("_b.n")).alias("near_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form (word, form): where its forms end. Jumps double, and a form is at least twice as common, so
    there are few rounds."""
    now, step = scratch.save(forms.select("word", F.col("form").alias("root")), "jump0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_r"))
        step += 1
        after = scratch.save(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), f"jump{step}")
        scratch.drop(f"jump{step - 1}")
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, lost: int | None = LOST, shortest: int = SHORTEST, rarest: int = RAREST, commoner: int = COMMONER, block: int = BLOCK) -> DataFrame:
    """One row per word of the vocabulary of ``docs``: word, n, n_near, form, form_n, root.

    The form is the commonest near word (ties: the smallest in code-point order) if it is at least ``commoner`` times as common as the
    word, else null, and form_n with it; n_near counts near words of any count. The root is where the forms end, the word itself if it has none.
    Null and empty texts hold no words; texts are read whole, and a text of one very long run of letters holds one long word. Rows that repeat
    a doc_id or have none count like others, once each. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, lost, shortest, rarest), "words")
    near = near_words(words, block=block, scratch=scratch)
    formed = F.col("near_n") >= commoner * F.col("n")
    met = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    met = scratch.save(met, "forms")
    ends = roots(met.where("form is not null").select("word", "form"), scratch)
    return met.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
