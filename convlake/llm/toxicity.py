"""Toxicity from class-conditional Kneser-Ney models.

An expression is a word, spelt out: each of its letters, and its end, is predicted from up to ``ORDER - 1`` signs
before it in the word. Toxic and ordinary documents have a model each: a class's own counts, discounted by n1 / (n1 + 2 n2),
and below them, with the mass that this class's discounts set free after these signs, continuation counts (how many
different signs stand before a run) which both classes share, down to single letters. So a rare form of a
known stem is judged by its stem, and a form that neither class knows says next to nothing.

A document's score compares the two log-likelihoods, normalised by its length, and those of its expressions:
what they have beyond ``MARGIN`` counts apart, by length and as a whole, so that a few insults in a long text are seen. A logistic
curve, fitted on training rows that weren't counted for it, makes this a probability.

Words are counted in Spark over all training rows, and the model is a table that follows from the words' counts. Where
its checked size allows, each task holds it as sorted arrays; else the documents' words meet it by sort-merge joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_checked
from .licenses import words_of
from .repeats import PrefixHashes, mix

#: Signs of a run, the predicted one included.
ORDER = 6
#: A word's log ratio counts as an expression's own from here on.
MARGIN = 4.0
#: One in so many training rows, by a hash of doc_id, fits the curve.
CURVE_SHARE = 5
#: The curve is fitted to so many of these rows at most, the first by that hash.
MAX_CURVE_ROWS = 20_000
#: Labels are broadcast up to so many rows (16 bytes each), else joined by sort-merge.
LABEL_ROWS = 1_000_000
#: Digests of rejected texts are broadcast up to so many (16 bytes each), else anti-joined by sort-merge.
REJECTED_ROWS = 500_000
#: A model of up to so many runs (16 bytes each) goes to every task, else words meet it by sort-merge.
BROADCAST_TERMS = 4_000_000
#: Words that a task remembers the ratios of.
REMEMBERED = 500_000
THRESHOLD = 0.3
SALT = np.uint64(0xA24BAED4963EE407)


class Spelling:
    """The runs of words: by sign that is predicted, its word, where its run starts and where it stands."""

    def __init__(self, words: list[bytes]):
        text = (b"\n" + b"\n\n".join(words) + b"\n").decode("utf-8", "surrogatepass")
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.flatnonzero(code == 10)  # no word has a line end, so they come in pairs
        self.sizes = ends[1::2] - ends[::2]
        code[ends[::2]] = 1
        self.of, self.begin = np.repeat(np.arange(len(words)), self.sizes), np.repeat(ends[::2], self.sizes)
        self.at = np.delete(np.arange(len(code)), ends[::2])
        self.start = np.maximum(self.begin, self.at - ORDER + 1)
        self.hashes = PrefixHashes(code)

    def runs(self) -> np.ndarray:
        return mix(self.hashes.of(self.start, self.at + 1))

    def before(self) -> np.ndarray:
        return mix(self.hashes.of(self.start, self.at) ^ SALT)

    def shorter(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the last k signs, where these are fewer than all, and what stands before their last."""
        start = np.maximum(self.at - k + 1, self.start)
        return self.hashes.of(start, self.at + 1), self.hashes.of(start, self.at)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, fold, t, o): how often a word stands in the toxic and the ordinary rows of a fold. Needs text, toxic 0/1 and fold 0/1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(fold, toxic): Counter() for fold in (0, 1) for toxic in (0, 1)}
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[fold, toxic].update(words_of(text.as_py()))
            for (fold, toxic), words in seen.items():
                if words:
                    n = [pa.array(words.values(), pa.int64()), pa.array(np.zeros(len(words), np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.full(len(words), fold, np.int32)), *(n if toxic else n[::-1])], ["word", "fold", "t", "o"])

    raw = rows.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int")).mapInArrow(run, "word binary, fold int, t long, o long")
    return raw.groupBy("word", "fold").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (word, t, o): the words' different runs, with the keys of their ends (``low``) and of what stands before those' last signs (``mid``), both from 1 sign on."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        spelt = Spelling(words)
        key, first, inverse = np.unique(spelt.runs(), return_index=True, return_inverse=True)
        t, o = (np.bincount(inverse, batch.column(k).to_numpy()[spelt.of], len(key)).astype(np.int64) for k in (1, 2))
        low, mid = (np.stack(x, axis=1)[first] for x in zip(*[spelt.shorter(k) for k in range(1, ORDER + 1)], strict=True))
        size = (spelt.at - spelt.start)[first] + 1  # the run is its own longest end
        edges = np.append(0, np.cumsum(size)).astype(np.int32)
        inside = np.arange(ORDER) < size[:, None]
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x[inside].view(np.int64))) for x in (low, mid)]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, spelt.before()[first])] + [pa.array(t), pa.array(o), *lists], ["key", "ctx", "t", "o", "low", "mid"])


def _discount(n: str) -> Column:
    """n1 / (n1 + 2 n2) of a column of counts; a half where no count is 1."""
    once, twice = F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)
    return F.when(once == 0, F.lit(0.5)).otherwise(once / (once + 2 * twice))


def model_terms(words: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(key, r): by run the log ratio of the classes; by signs of which no class knows what follows, that of the mass set free.

    ``words`` has word, t and o. At both the shared counts cancel or are worked out once, so a score needs no other table.
    """
    raw = words.select("word", "t", "o").mapInArrow(_runs, "key long, ctx long, t long, o long, low array<long>, mid array<long>")
    full = raw.groupBy("key").agg(*[F.first(c).alias(c) for c in ("ctx", "low", "mid")], F.sum("t").alias("t"), F.sum("o").alias("o"))
    full = scratch.save(full, f"runs-{label}")
    # a run of k signs is continued backwards by the different runs of k + 1 that end in it
    step = F.transform(F.sequence(F.lit(1), F.size("low") - 1), lambda k: F.struct(k.alias("k"), F.get("low", k).alias("longer"), F.get("low", k - 1).alias("key"), F.get("mid", k - 1).alias("mid")))
    kinds = full.select(F.inline(step)).distinct()
    counts = scratch.save(kinds.groupBy("k", "key").agg(F.first("mid").alias("mid"), F.count("*").alias("n")), f"continued-{label}")
    off = {r["k"]: float(r["d"]) for r in counts.groupBy("k").agg(_discount("n").alias("d")).collect()}  # ORDER rows
    d = F.element_at(F.create_map(*[F.lit(x) for pair in off.items() for x in pair]), F.col("k")) if off else F.lit(0.5)
    sums = counts.groupBy("k", "mid").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    shares = counts.hint("merge").join(sums.hint("merge"), ["k", "mid"]).select("k", F.col("key").alias("low"), ((F.col("n") - d) / F.col("all")).alias("own"), (d * F.col("kinds") / F.col("all")).alias("free"))
    signs = counts.where("k = 1").count()
    ends = full.select("key", F.posexplode(F.slice("low", 1, F.size("low") - 1)).alias("k", "low")).withColumn("k", F.col("k") + 1)
    # a letter may end a tenth of all runs; letters are broadcast, as there are 1,114,112 code points at most
    letters = ends.where("k = 1").join(F.broadcast(shares.where("k = 1")), ["k", "low"])
    longer = ends.where("k > 1").hint("merge").join(shares.where("k > 1").hint("merge"), ["k", "low"])
    met = letters.unionByName(longer).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "own", "free"))).alias("chain"))  # ORDER - 1 at most
    shared = met.select("key", F.aggregate("chain", F.lit(1.0 / (signs + 1)), lambda p, x: x["own"] + x["free"] * p).alias("p"))
    follow = full.groupBy("ctx").agg(*[F.sum(c).alias(f"all_{c}") for c in ("t", "o")], *[F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in ("t", "o")])
    follow = scratch.save(follow, f"follow-{label}")
    d_t, d_o = full.agg(_discount("t").alias("t"), _discount("o").alias("o")).first()

    def free(c: str, off: float) -> Column:
        """The mass that a class's discounts set free after the signs; all of it after signs that it doesn't know."""
        return F.when(F.col(f"all_{c}") > 0, F.lit(off) * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0)

    def known(c: str, off: float) -> Column:
        return F.coalesce(F.greatest(F.col(c) - F.lit(off), F.lit(0.0)) / F.nullif(F.col(f"all_{c}"), F.lit(0)), F.lit(0.0)) + free(c, off) * F.col("p")

    runs = full.select("key", "ctx", "t", "o").join(shared.hint("merge"), "key").join(follow.hint("merge"), "ctx")
    terms = runs.select("key", F.log(known("t", d_t) / known("o", d_o)).alias("r")).unionByName(follow.select(F.col("ctx").alias("key"), F.log(free("t", d_t) / free("o", d_o)).alias("r")))
    terms = scratch.save(terms, f"terms-{label}")
    scratch.drop(f"runs-{label}", f"continued-{label}", f"follow-{label}")
    return terms


class Ratios:
    """Log ratios of words by a model held as arrays, remembered."""

    def __init__(self, keys: np.ndarray, r: np.ndarray):
        self.keys, self.r, self.memo = keys, r, {}
        self.ratio, self.signs = np.zeros(1024), np.zeros(1024)

    def look(self, key: np.ndarray) -> np.ndarray:
        """Values by key, NaN where there is none."""
        if not len(self.keys):
            return np.full(len(key), np.nan)
        ask, inverse = np.unique(key, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
        return np.where(self.keys[place] == ask, self.r[place], np.nan)[inverse]

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio and number of signs of each word."""
        spelt = Spelling(words)
        r = self.look(spelt.runs())
        open_ = np.flatnonzero(np.isnan(r))
        r[open_] = np.nan_to_num(self.look(spelt.before()[open_]))
        return np.bincount(spelt.of, r, len(words)), spelt.sizes

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        fresh = list(set(words).difference(self.memo))
        if len(self.memo) + len(fresh) > REMEMBERED and self.memo:
            self.memo.clear()
            fresh = list(set(words))
        for part in range(0, len(fresh), 20_000):
            new = fresh[part : part + 20_000]
            at, until = len(self.memo), len(self.memo) + len(new)
            if until > len(self.ratio):
                self.ratio, self.signs = (np.resize(x, 2 * until) for x in (self.ratio, self.signs))
            self.ratio[at:until], self.signs[at:until] = self.spell(new)
            self.memo.update(zip(new, range(at, until), strict=True))
        ids = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return self.ratio[ids], self.signs[ids]


@lru_cache(maxsize=1)
def _held(model: Broadcast) -> Ratios:
    """A worker's ratios outlast its tasks; a worker gets the same model as one object."""
    return Ratios(*model.value)


def _measure(model: Broadcast) -> Callable:
    """From rows that end in a text: their other columns, the sums of ratios, of signs and of what ratios have beyond the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = _held(model)

        def sums(held: list[list[bytes]]) -> np.ndarray:
            r, n = ratios.of(list(chain.from_iterable(held)))
            of = np.repeat(np.arange(len(held)), [len(w) for w in held])
            return np.stack([np.bincount(of, x, len(held)) for x in (r, n, np.maximum(r - MARGIN, 0))])

        for batch in batches:
            out, held, size = [np.zeros((3, 0))], [], 0
            for text in batch.column(batch.num_columns - 1):
                held.append(words_of(text.as_py()))
                size += len(held[-1])
                if size > 200_000:
                    out.append(sums(held))
                    held, size = [], 0
            if held:
                out.append(sums(held))
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, np.concatenate(out, axis=1))], [*names, "total", "signs", "beyond"])

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (h1, h2, text): each text's different words, how often each, and its number of signs."""
    for batch in batches:
        for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if words := Counter(words_of(text.as_py())):
                signs = Spelling(list(words)).sizes
                same = [pa.array(np.full(len(words), h)) for h in (h1, h2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(words, pa.binary()), pa.array(words.values(), pa.int64()), pa.array(signs)], ["h1", "h2", "word", "n", "signs"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (word): the keys of its runs and of what stands before their last signs."""
    for batch in batches:
        if words := batch.column(0).to_pylist():
            spelt = Spelling(words)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).take(pa.array(spelt.of)), *[pa.array(x.view(np.int64)) for x in (spelt.runs(), spelt.before())]], ["word", "key", "ctx"])


def joined_sums(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """What _measure gives, by sort-merge joins: words meet the model's terms, then the texts they stand in."""
    occurs = texts.mapInArrow(_occurrences, "h1 long, h2 long, word binary, n long, signs long").groupBy("h1", "h2", "word").agg(F.first("n").alias("n"), F.first("signs").alias("signs"))
    asked = occurs.select("word").distinct().mapInArrow(_asked, "word binary, key long, ctx long")
    by_run = asked.hint("merge").join(terms.hint("merge"), "key", "left").select("word", "ctx", F.col("r").alias("own"))
    free = terms.select(F.col("key").alias("ctx"), "r").hint("merge")
    ratios = by_run.join(free, "ctx", "left").groupBy("word").agg(F.sum(F.coalesce("own", "r", F.lit(0.0))).alias("r"))
    met = occurs.hint("merge").join(ratios.hint("merge"), "word")
    total, beyond = F.col("n") * F.col("r"), F.col("n") * F.greatest(F.col("r") - MARGIN, F.lit(0.0))
    return met.groupBy("h1", "h2").agg(F.sum(total).alias("total"), F.sum(F.col("n") * F.col("signs")).cast("double").alias("signs"), F.sum(beyond).alias("beyond"))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) of a logistic curve with a small ridge, by Newton steps."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (y - p) - 0.1 * w)
    return w


def digests() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), F.col("text")).alias("h1"), F.xxhash64(F.lit(2), F.col("text")).alias("h2")


class ToxicityModel:
    """terms (key, r) and the curve's weights; terms are held as arrays if there are at most ``limit``."""

    def __init__(self, terms: DataFrame, limit: int = BROADCAST_TERMS):
        self.terms, self.curve, self.held = terms, np.zeros(4), None
        if terms.limit(limit + 1).count() <= limit:
            got = terms.toArrow()
            key, r = got.column("key").to_numpy().view(np.uint64), got.column("r").to_numpy()
            order = np.argsort(key)
            self.held = terms.sparkSession.sparkContext.broadcast((key[order], r[order]))

    def features(self, docs: DataFrame, own: str) -> DataFrame:
        """For each row its column ``own``, h1 and h2 (the text's digest) and a, e, l: log ratio and what is beyond the margin, by signs, and the latter's logarithm."""
        rows = docs.select(F.col(own).cast("long").alias(own), *digests(), "text")
        if self.held:
            sums = rows.mapInArrow(_measure(self.held), f"{own} long, h1 long, h2 long, total double, signs double, beyond double")
        else:
            sums = rows.drop("text").hint("merge").join(joined_sums(rows.drop(own), self.terms), ["h1", "h2"], "left").na.fill(0.0, ["total", "signs", "beyond"])
        by = F.col("signs") + 100
        return sums.select(own, "h1", "h2", (100 * F.col("total") / by).alias("a"), (100 * F.col("beyond") / by).alias("e"), F.log1p("beyond").alias("l"))

    def fit(self, rows: DataFrame) -> None:
        """Fit the curve to rows with text and toxic; their number is bounded by the caller."""
        got = self.features(rows, "toxic").select("a", "e", "l", "toxic").toArrow()
        x = np.stack([c.to_numpy() for c in got.columns], axis=1)
        self.curve = fit_curve(x[:, :3], x[:, 3])

    def scored(self, docs: DataFrame) -> DataFrame:
        """doc_id, h1, h2 and score (0 to 1) for each row; null and empty texts get the curve's value at no evidence."""
        w = [F.lit(float(x)) for x in self.curve]
        z = w[0] + w[1] * F.col("a") + w[2] * F.col("e") + w[3] * F.col("l")
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        return self.features(docs, "doc_id").select("doc_id", "h1", "h2", score.alias("score"))

    def score(self, docs: DataFrame) -> DataFrame:
        return self.scored(docs).select("doc_id", "score")

    def accepted(self, docs: DataFrame, threshold: float) -> DataFrame:
        """The rows of ``docs``, all columns, that score below the threshold; a score depends on the text alone, so texts carry the verdict."""
        above = self.scored(docs).where(F.col("score") >= threshold).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
        rejected = Scratch(docs.sparkSession, "toxicity").save(above, "rejected")
        h1, h2 = digests()
        known = docs.withColumns({"_h1": h1, "_h2": h2})
        return join_checked(known, rejected, ["_h1", "_h2"], "left_anti", REJECTED_ROWS).select(*docs.columns)


class ConstantModel(ToxicityModel):
    """Where training rows of a class are missing: all documents are like the class that there is (ordinary, if none)."""

    def __init__(self, score: float):
        self.value = score

    def scored(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *digests(), F.lit(self.value).alias("score"))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the doc_id's digits leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = BROADCAST_TERMS) -> ToxicityModel:
    """Learn from all labelled rows that aren't held out. A doc_id labelled twice is toxic if any label says so.

    Null labels, null doc_ids and labels without a document count for nothing; with rows of one class alone every
    score is that class's, with none it is 0. The curve is fitted with a model that hasn't counted the curve's rows;
    the model that scores has counted all. Where a class has no row among the curve's, all training rows fit it.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id").cast("long")), 33)  # 0 to 2^31 - 1
    rows = join_checked(docs.select("doc_id", "text"), known, ["doc_id"], limit=LABEL_ROWS).withColumns({"draw": draw, "fold": (draw < F.lit(2**31 // CURVE_SHARE)).cast("int")})
    classes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    if len({y for _, y in classes}) < 2:
        return ConstantModel(float(any(y for _, y in classes)))
    words = scratch.save(count_words(rows), "words")
    full = ToxicityModel(model_terms(words.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), scratch, "all"), limit)
    apart = all((f, y) in classes for f in (0, 1) for y in (0, 1))
    part = ToxicityModel(model_terms(words.where("fold = 0"), scratch, "part"), limit) if apart else full
    own = rows.where("fold = 1") if apart else rows
    n = sum(k for (f, _), k in classes.items() if f or not apart)
    share = min(1.0, MAX_CURVE_ROWS * 0.95 / n) / (CURVE_SHARE if apart else 1)
    part.fit(own.where(F.col("draw") < F.lit(int(2**31 * share))).limit(MAX_CURVE_ROWS))
    full.curve = part.curve
    return full


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; only texts are scored, other columns are ignored.

    Whole texts are read, however long. Rows that repeat a text get the same score, an empty table gives no rows.
    """
    scored = fit_toxicity(docs, labels).score(docs)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
