"""Embedding near-dedup with randomised-rotation binary codes.

A vector's code holds the signs of its coordinates under seeded random rotations; stored with it is the factor that
makes the inner product of another vector with the code an unbiased estimate of their cosine. The estimate's
confidence bound decides which pairs need the exact cosine. The codes' leading bits, band by band, also say which
vectors meet at all: the number of bands follows from the chance that a pair at the threshold agrees on a band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .simhash import forest

SEED = 11
#: A pair at the threshold meets in some band with this probability; nearer pairs meet with a larger one.
RECALL = 0.9999
#: Standard errors of the estimate that the bound allows.
SIGMAS = 4.0
MIN_BITS = 256
TILE = 1_024


@lru_cache(maxsize=8)
def rotations(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Random rotations under each other, so many that they give ``bits`` signs at least; each row is a direction."""
    draw = np.random.default_rng([seed, dim])
    return np.vstack([np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(ceil(bits / dim))])


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (boolean) and correction factors."""
    turned = unit @ turn.T
    return turned > 0, 1 / np.abs(turned).sum(axis=1)


def estimate(unit: np.ndarray, signs: np.ndarray, factor: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of ``unit`` (rows) with the coded vectors (columns) as estimated, and a standard error by column.

    The code's own cosine with its vector is f; what is orthogonal to it is spread evenly by the rotation.
    """
    product = (unit @ turn.T) @ np.where(signs, 1.0, -1.0).T
    f = 1 / (factor * sqrt(unit.shape[1]) * (len(turn) / unit.shape[1]))
    error = np.sqrt(np.maximum(1 - f * f, 0) / (f * f * max(len(turn) - 1, 1)))
    return product * factor, error


def compare_cell(threshold: float, bits: int, sigmas: float = SIGMAS):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("cid", kind="stable")
        side, cid, mult = (cell[c].to_numpy() for c in ("side", "cid", "mult"))
        unit = units(np.stack(cell["embedding"].to_numpy()))
        keys, band = np.stack(cell["keys"].to_numpy()), int(cell["band"].iloc[0])
        turn = rotations(unit.shape[1], bits)
        signs = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in cell["code"]]), axis=1)[:, : len(turn)].astype(bool)
        x, y, factor = np.flatnonzero(side != 2), np.flatnonzero(side != 1), cell["factor"].to_numpy()
        guess, error = estimate(unit[x], signs[y], factor[y], turn)
        i, j = np.nonzero((guess + sigmas * error >= threshold) | np.isinf(sigmas))
        i, j = x[i], y[j]
        fresh = ~(keys[i, :band] == keys[j, :band]).any(axis=1)  # else an earlier band has counted the pair
        if (side == 0).any():
            fresh &= i < j
        i, j = i[fresh], j[fresh]
        near = np.concatenate([(unit[i[k : k + 65_536]] * unit[j[k : k + 65_536]]).sum(axis=1) >= threshold for k in range(0, len(i), 65_536)] or [np.empty(0, bool)])
        i, j = i[near], j[near]
        links = np.bincount(i, mult[j], len(cid)) + np.bincount(j, mult[i], len(cid))
        root = forest(len(cid), i, j)
        some = np.flatnonzero(links)
        return pd.DataFrame({"cid": cid[some], "links": links[some].astype(np.int64), "root": cid[root[some]]})

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, width: int | None = None, exact: bool = False) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors with equal labels, not null, and equal lengths link. Vectors that are null, empty, zero or hold
    null or non-finite numbers link with nothing, nor do rows without a vec_id. Equal vectors of a label are one
    class, compared once; its rows count as links of each other and of all that links with one of them. Rows that repeat
    a vec_id are rows of their class; other columns are ignored; an empty table gives no rows.

    ``width`` is the bits of a band; unless given it follows from the largest label, and the number of bands from it, so that a
    pair at the threshold meets with the chance RECALL whatever the width. The README has what was measured. ``exact`` loses no pair: all tile
    pairs of a label meet, and every pair in them is recomputed, which takes the square of a label's vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    e = F.col("embedding")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    valid = F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(valid, F.xxhash64(e, F.lit(1))).alias("h1"), F.when(valid, F.xxhash64(F.lit(2), e)).alias("h2"), F.when(valid, e).alias("embedding"))
    classes = rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"))
    classes = scratch.save(classes.withColumn("dim", F.size("embedding")), "classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    width = 0 if exact else width or min(24, max(2, ceil(log(max(most, 1) / TILE + 1, 2))))
    agree = 1 - acos(threshold) / pi
    bands = 1 if exact else max(1, ceil(log(1 - RECALL) / log(1 - agree**width)))
    bits = max(MIN_BITS, width * bands)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(width)).astype(np.int64)
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            codes, factors, keys = [b""] * len(found), np.zeros(len(found)), [[]] * len(found)
            sizes = np.array([len(v) for v in found])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                turn = turns.setdefault(dim, rotations(dim, bits))
                signs, factor = encode(units(np.stack(found[at])), turn)
                banded = signs[:, : width * bands].reshape(len(at), bands, width) @ weights
                for k, i in enumerate(at):
                    codes[i], factors[i], keys[i] = np.packbits(signs[k]).tobytes(), factor[k], banded[k].tolist()
            names = ["embedding", "label", "dim", "cid", "mult", "code", "factor", "keys"]
            columns = [*batch.columns, pa.array(codes, pa.binary()), pa.array(factors), pa.array(keys, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(classes.dtypes)
    columns = f"embedding {kind['embedding']}, label {kind['label']}, dim int, cid long, mult long"
    coded = classes.select("embedding", "label", "dim", F.col("cid").cast("long"), "mult").mapInArrow(code, f"{columns}, code binary, factor double, keys array<int>")
    coded = scratch.save(coded, "coded")
    bucket = ["label", "dim", "band", "key"]
    met = coded.select("*", F.posexplode("keys").alias("band", "key"))
    tiles = met.groupBy(*bucket).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    met = met.join(tiles.hint("merge"), bucket).withColumn("s", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("s") == F.col("o"), 0).when(F.col("s") < F.col("o"), 1).otherwise(2).alias("side")
    cells = met.select(*bucket, F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"), side, "cid", "mult", "embedding", "code", "factor", "keys")
    found = cells.groupBy(*bucket, "x", "y").applyInPandas(compare_cell(threshold, bits, float("inf") if exact else SIGMAS), "cid long, links long, root long")
    found = scratch.save(found, "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch).select(F.col("node").alias("cid"), "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(links.hint("merge"), "cid", "left").join(roots.hint("merge"), "cid", "left")
    named = named.select("label", "h1", "h2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    named = scratch.save(named, "named")
    out = rows.drop("embedding").join(named.hint("merge"), ["label", "h1", "h2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
