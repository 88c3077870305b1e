"""SimHash near-dedup by tiled exact comparison.

Different fingerprints are put side by side in tiles and compared exactly with numpy: exclusive-or, then bit
counts. Two fingerprints within 3 bits agree on one of their four 16-bit words, so tiles are cut once for each
word, from fingerprints that agree on the word's leading bits; how many bits follows from the number of
fingerprints, so that a group fills about one tile. A group that needs more tiles is cut by population count, and
two tiles are compared only if their population counts differ by 3 or less. All links are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

RADIUS = 3
SEED = 42
TILE = 4_096
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of each run of ``size`` words (of all words if there are fewer); bytes.split parts at the six blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65_536):
        bits += np.unpackbits(hashes[part : part + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint as a signed long. Whole texts are read; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n-1 and links (i, j): each node's smallest node that it reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the fingerprints within ``radius`` bits, some rows of the tile at a time."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[part : part + 256, None] ^ b[None, :]) <= radius)
        left.append(i + part)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def compare_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """One pair of tiles: links as edges (a, b) from each fingerprint's node to the smallest it reaches here."""
    cell = cell.sort_values("node", kind="stable")
    codes, nodes, side = cell["fp"].to_numpy().view(np.uint64), cell["node"].to_numpy(), cell["side"].to_numpy()
    x, y = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    i, j = compare_tiles(codes[x], codes[y])
    root = forest(len(codes), x[i], y[j])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})


def near_links(classes: DataFrame, total: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between nodes that join every two fingerprints within the radius, directly or through others.

    ``classes`` has one row per fingerprint: fp, node. A cell is a pair of tiles of one group: side 1 and side 2, or
    side 0 for a tile with itself. The edges of a cell are a forest, so their number is bounded by its rows.
    """
    bits = max(0, min(16, int(np.ceil(np.log2(max(total, 1) / tile)))))
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.shiftrightunsigned(F.col("fp"), 64 - 16 * w - bits).bitwiseAND(F.lit(2**bits - 1)).alias("v")) for w in range(4 if bits else 1)])
    rows = classes.select("fp", "node", F.bit_count("fp").alias("pc"), F.explode(words).alias("g")).select("fp", "node", "pc", "g.w", "g.v")
    group = ["w", "v"]
    counts = rows.groupBy(*group, "pc").count()
    cuts = F.collect_list(F.struct("pc", F.ceil(F.col("count") / tile).alias("cuts")))
    sizes = counts.groupBy(*group).agg(F.sum("count").alias("n"), cuts.alias("tiles"))  # 65 population counts at most
    one = F.col("n") <= tile
    joined = rows.join(sizes.hint("merge"), group)
    own = F.filter("tiles", lambda t: t["pc"] == F.col("pc"))[0]["cuts"]
    placed = joined.withColumn("p", F.when(one, F.lit(-1)).otherwise(F.col("pc"))).withColumn("s", F.when(one, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), own)).cast("int"))
    near = F.filter("tiles", lambda t: F.abs(t["pc"] - F.col("pc")) <= RADIUS)
    others = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), (t["cuts"] - 1).cast("int")), lambda s: F.struct(t["pc"].cast("int").alias("p"), s.alias("s")))))
    others = F.when(one, F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("s")))).otherwise(others)
    pairs = placed.withColumn("o", F.explode(others))
    mine, other = F.struct("p", "s"), F.struct(F.col("o.p"), F.col("o.s"))
    side = F.when(mine == other, 0).when(mine < other, 1).otherwise(2)
    cells = pairs.select(*group, F.least(mine, other).alias("x"), F.greatest(mine, other).alias("y"), side.alias("side"), "fp", "node")
    cells = cells.select(*group, F.col("x.p").alias("p1"), F.col("x.s").alias("s1"), F.col("y.p").alias("p2"), F.col("y.s").alias("s2"), "side", "fp", "node")
    return cells.groupBy(*group, "p1", "s1", "p2", "s2").applyInPandas(compare_cell, "a long, b long")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id that is reachable over fingerprints within 3 bits, itself included. Null and
    empty texts have fingerprint zero and link with each other and whatever else is near it. Rows that repeat are
    rows of one class; a null doc_id is never a component's id unless no other is in its class (then it is null). An empty
    table gives no rows; a text's words are hashed as they are, however long it is, and its bits counted some at a time.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs), "fingerprints")
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = scratch.save(classes.where("least is not null").select("fp", F.col("least").alias("node")), "nodes")
    edges = near_links(nodes, classes.count())
    roots = components(edges, scratch).select(F.col("node").alias("_node"), "root")
    named = nodes.join(roots.hint("merge"), F.col("node") == F.col("_node"), "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    named = scratch.save(named, "components")
    out = rows.join(named.hint("merge"), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
