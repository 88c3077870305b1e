"""Best-fit packing by exact complements.

Every document is tokenised once and cut into pieces that fit a sequence. There are at most ``capacity`` different
lengths, so the counts by length are a small table whatever the corpus; on it the packing is planned in bulk.
From the longest length down, the gap that a piece leaves is looked up among the available single, pair and triple
length sums, and a combination that fills it exactly is used as often as availability allows; what is left is
placed by best fit. Pieces get their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, ranked, spread

CAPACITY = 2_048
END = 0
RANKS = 1 << 40
#: Words that a task remembers the ids of (about 170 bytes each).
REMEMBERED = 1_000_000
# Byte-level vocabularies write these bytes as the characters of their numbers, all others in turn from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Letters and signs are merged apart.
LETTERS_THEN_SIGNS = re.compile(r"([^\W\d_]+)([^\w\s\x1c-\x1f]+)")
#: Where a blank stands between white space: such texts aren't parted at blanks.
CLOSE_BLANKS = re.compile(r"[\s\x1c-\x1f] (?:[\s\x1c-\x1f]|$)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Remembered(dict):
    """Little-endian 32-bit ids of ``lead`` and a word, by the tokenizers library, asked once for each that is short.

    When ``REMEMBERED`` are held, others are encoded each time they come: the bound limits memory, not what is encoded.
    """

    def __init__(self, tokenizer: Tokenizer, lead: str, plain: Remembered | None = None):
        self.tokenizer, self.model, self.lead, self.plain = tokenizer, tokenizer.model, lead, self if plain is None else plain
        others = [b for b in range(256) if b not in PLAIN]
        self.written = {b: chr(256 + others.index(b) if b in others else b) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        cut = word.find("\n", 1)
        if cut > 0 and not word[cut - 1].isspace() and not word[cut + 1 : cut + 2].isspace():
            found = self[word[:cut]] + self.plain["\n"] + (self.plain[word[cut + 1 :]] if cut + 1 < len(word) else b"")
        elif word.isalpha():  # letters, after a blank or not, are merged as one
            raw = (self.lead + word).encode().decode("latin-1").translate(self.written)
            ids = [t.id for t in self.model.tokenize(raw)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        elif (parts := LETTERS_THEN_SIGNS.fullmatch(word)) and parts[1].isalpha():
            found = self[parts[1]] + self.plain[parts[2]]
        else:
            ids = self.tokenizer.encode(self.lead + word, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = found
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """A text's ids as bytes: those that the library's encode of the whole text gives.

    No merge crosses a blank that follows a letter, sign or digit, so a text's ids are those of its words, each with the blank
    before it. Other kinds of tokenizers get whole texts. A text with blanks among other white space, or with the string of a special token, is so too.
    """
    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    by_words = parts["normalizer"] is None and parts["model"]["type"] == "BPE" and parts["pre_tokenizer"] == BYTE_LEVEL
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    plain = Remembered(tokenizer, "")
    after_blank = Remembered(tokenizer, " ", plain)

    def encode(text: str) -> bytes:
        if not by_words or CLOSE_BLANKS.search(text) or any(s in text for s in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return plain[first] + b"".join(map(after_blank.__getitem__, rest))

    return encode


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), with the ids themselves (little-endian, 32 bits) if asked.

    A document is its ids and id 0. Only a longer one is cut; the first piece takes what full pieces leave over.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode(text.as_py() or "") + END.to_bytes(4, "little"), "<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    rows.append((doc, k, a, b - a, zlib.crc32(raw), raw if keep_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(len(names))], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Sums:
    """An index of the lengths whose sum is a given one: by sum a single length, a pair and a triple, each the one with the longest
    first length that is still available.

    Counts only fall, so a combination that has run out never comes back: each sum keeps the first length it has come down
    to, and looks on from there. What is only short because of the piece that asks is passed over and stays.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs, self.triples = (np.arange(len(left)) - n for n in (1, 2))  # the longest first length a sum can have

    def single(self, total: int, mine: int) -> list[int]:
        return [total] if self.left[total] > (total == mine) else []

    def _pair(self, a: int, b: int, taken: tuple[int, ...]) -> bool:
        return self.left[a] >= 1 + (a == b) + taken.count(a) and self.left[b] >= 1 + (a == b) + taken.count(b)

    def pair(self, total: int, taken: tuple[int, ...]) -> list[int]:
        a = int(self.pairs[total]) if total > 1 else 0
        while 2 * a >= total and not self._pair(a, total - a, ()):
            a -= 1
        if total > 1:
            self.pairs[total] = a
        while 2 * a >= total:
            if self._pair(a, total - a, taken):
                return [a, total - a]
            a -= 1
        return []

    def triple(self, total: int, mine: int) -> list[int]:
        a = int(self.triples[total]) if total > 2 else 0
        gone = True  # whether all first lengths so far have run out
        while a > 0:
            rest = self.left[a] and self.pair(total - a, (a,))
            if rest and self.left[a] > (a == mine) and (found := self.pair(total - a, (a, mine))):
                return [a, *found]
            gone = gone and not rest
            a -= 1
            if gone:
                self.triples[total] = a
        return []


class Plan:
    """Places by length: runs (length, first rank, count, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self._exact()
        self._best_fit()

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def _use(self, lengths: list[int]) -> None:
        """The combination as often as its lengths are available; each time fills a sequence."""
        times = min(int(self.left[x]) // lengths.count(x) for x in set(lengths))
        at = 0
        for x in lengths:
            self._place(x, times, self.sequences, at)
            at += x
        self.sequences += times

    def _exact(self) -> None:
        """From the longest piece down: the gap that it leaves is filled by a single length, a pair or a triple of just that sum."""
        sums = Sums(self.left)
        for length in range(self.capacity, 0, -1):
            gap = self.capacity - length
            while self.left[length]:
                found = [] if gap == 0 else sums.single(gap, length) or sums.pair(gap, (length,)) or sums.triple(gap, length)
                if gap and not found:
                    break
                self._use([length, *found])

    def _best_fit(self) -> None:
        bins: dict[int, list[list[int]]] = {}  # by gap: [first sequence, how many]
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while n := int(self.left[length]):
                gap = next((g for g in range(length, self.capacity) if bins.get(g)), None)
                if gap is None:
                    n = -(-n // (self.capacity // length))  # so many new sequences hold all of this length
                    first, self.sequences = self.sequences, self.sequences + n
                    self._place(length, n, first, 0)
                else:
                    first, many = bins[gap].pop()
                    n = min(n, many)
                    if many > n:
                        bins[gap].append([first + n, many - n])
                    self._place(length, n, first, self.capacity - gap)
                rest = (self.capacity if gap is None else gap) - length
                if rest:
                    bins.setdefault(rest, []).append([first, n])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked).

    A null text is an empty one, a single id 0. Rows that repeat are packed each; a null doc_id is carried along.
    No sequence is longer than ``capacity``, and offsets are gapless from 0. The plan is sent to every task; it has a
    few runs for each of the ``capacity`` lengths, whatever the number of documents.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.save(pieces_of(docs, capacity, tokenizer, keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(sorted(Plan(counts, capacity).runs), np.int64).reshape(-1, 5)
    starts = plan[:, 0] * RANKS + plan[:, 1]
    placed = ranked(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start")], spread("doc_id", "piece"), sum(counts.values()), "_rank")
    order = [c for c in pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            run = plan[np.searchsorted(starts, length * RANKS + rank, side="right") - 1]
            own = batch.select(order).columns
            yield pa.RecordBatch.from_arrays([*own, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*order, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return placed.select(*order, "_rank").mapInArrow(place, schema)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per sequence: sequence_id, ids (array of int), documents (array of doc_id, offset, length)."""
    placed = pack(docs, capacity, tokenizer, keep_ids=True)
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))  # at most `capacity` pieces

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in row.as_py()), "<u4").astype(np.int32) for row in batch.column(1)]
            docs_ = [[{k: p[k] for k in ("doc_id", "offset", "length")} for p in row.as_py()] for row in batch.column(1)]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(docs_, kind)], ["sequence_id", "ids", "documents"])

    return placed.groupBy("sequence_id").agg(inside.alias("inside")).mapInArrow(join, "sequence_id long, ids array<int>, documents array<struct<doc_id:long,offset:long,length:long>>")
