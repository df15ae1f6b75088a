"""Packing of tokenised documents into sequences, by column generation for the cutting-stock problem.

1. Documents are tokenised. Whole stretches of capacity ids are sequences of their own; the rest of each document is
   one remainder, shorter than the capacity.
2. The histogram of remainder lengths (fewer rows than the capacity, whatever the corpus) goes to the driver. A linear
   program over patterns that fill a sequence exactly is solved by column generation: its duals price lengths, and a
   knapsack over the capacity finds the cheapest exact fills, until none pays or MAX_COLUMNS went in. Pattern counts are
   rounded, and what they leave over is the demand of the next program, for up to ROUNDS of them. The work is bounded
   by these two numbers and the capacity, not by the corpus.
3. Remainders are ranked within their length: range-partitioned, counted by partition, and numbered by adding the
   counts before. So ranks need no task that sees all remainders of a length. A rank's sequence and offset follow by
   arithmetic from the patterns' counts.
4. What no pattern takes is laid end to end and cut at sequence ends, the last ones at powers of two. So nothing is
   padded, and each id lies in exactly one piece.

Null texts are empty; an empty document is the end id alone. Rows that repeat a document are packed each. Ties within
a length are ranked by id, then start. A null id is packed with a null doc_id. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._bytes import trim
from finsift.llm._shared import read, written

CAPACITY = 2048
END_ID = 1
#: Pricings in a row without a gain of a thousandth, after which a program ends.
PATIENCE = 3
#: Patterns that go into one linear program, at most; share of the ids that may be left to be laid end to end; rounds.
MAX_COLUMNS, LEAST_LEFT, ROUNDS = 800, 0.005, 12


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(tokenizer: str, ranks: str | None):
    """text -> ids as the tokenizer file says; with a file of the same vocabulary as ranks, by the faster library."""
    from tokenizers import Tokenizer

    if ranks is None:
        slow = Tokenizer.from_file(tokenizer)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    with open(tokenizer, encoding="utf-8") as file:
        added = [x["content"] for x in json.load(file)["added_tokens"]]
    held = []

    def encode(text: str) -> np.ndarray:
        if any(a in text for a in added):  # such strings are ids of their own, which only the tokenizer file knows
            held[:] = held or [Tokenizer.from_file(tokenizer)]
            return np.array(held[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, ranks: str | None, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) of whole stretches (without ids) and remainders."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity].tobytes()
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), len(ids), None if len(part) == 4 * capacity else _small(part)))
                if len(rows) >= 20_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)
        trim()

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _small(part: bytes) -> bytes:
    """A byte for the width, then the ids in two bytes each where they fit."""
    ids = np.frombuffer(part, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + part


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored[1:], "<u2" if stored[:1] == b"\x02" else "<u4").astype("<u4")


def exact_fills(lengths: np.ndarray, price: np.ndarray, capacity: int, most: int) -> list[np.ndarray]:
    """Patterns (counts by length) that sum to capacity and cost least, by knapsack; several, with different first lengths."""
    best = np.full(capacity + 1, np.inf)
    best[0] = 0
    last = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if upto[c]:
            cost = price[: upto[c]] + best[c - lengths[: upto[c]]]
            k = int(cost.argmin())
            best[c], last[c] = cost[k], k
    total = price + best[capacity - lengths]
    out = []
    used = np.zeros(len(lengths), bool)
    for first in np.argsort(total, kind="stable"):
        if len(out) >= most or not np.isfinite(total[first]):
            break
        counts = np.zeros(len(lengths), np.int64)
        counts[first] += 1
        left = capacity - lengths[first]
        while left:
            counts[last[left]] += 1
            left -= lengths[last[left]]
        if not (used & (counts > 0)).any():
            used |= counts > 0
            out.append(counts)
    return out


class Master:
    """The linear program: of the patterns found so far, how often each is used, so that most ids are in filled sequences.

    A basis is some patterns and as many lengths that they use up; all other lengths have some demand left. So only a
    matrix of the size of the patterns is inverted, whatever the number of lengths.
    """

    REFACTOR = 200

    def __init__(self, demand: np.ndarray, capacity: int):
        self.demand, self.capacity = demand.astype(float), capacity
        self.columns = np.zeros((len(demand), 64))
        self.rows = np.zeros(0, np.int64)
        self.inverse, self.times, self.left, self.turns = np.zeros((0, 0)), np.zeros(0), demand.astype(float), 0
        self.price = np.zeros(len(demand))  # what one more of a length would gain

    def enter(self, counts: np.ndarray) -> bool:
        """Brings a pattern in, as long as that gains; which pattern or length goes out, the ratios tell."""
        gain = self.capacity - self.price @ counts
        if gain <= 1e-6 * self.capacity:
            return False
        k = len(self.rows)
        way = self.inverse @ counts[self.rows]
        used = counts - self.columns[:, :k] @ way
        used[self.rows] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            by_pattern = np.where(way > 1e-9, self.times / way, np.inf)
            by_length = np.where(used > 1e-9, self.left / used, np.inf)
        row, old = int(by_length.argmin()), int(by_pattern.argmin()) if k else -1
        step = max(0.0, min(by_length[row], by_pattern[old] if k else np.inf))
        if not np.isfinite(step):
            return False
        self.times = np.maximum(self.times - step * way, 0)
        self.left = np.maximum(self.left - step * used, 0)
        if not k or by_length[row] <= by_pattern[old]:
            if k == self.columns.shape[1]:
                self.columns = np.hstack([self.columns, np.zeros_like(self.columns)])
            across = self.columns[row, :k] @ self.inverse
            grown = np.empty((k + 1, k + 1))
            grown[:k, :k] = self.inverse + np.outer(way / used[row], across)
            grown[:k, k], grown[k, :k], grown[k, k] = -way / used[row], -across / used[row], 1 / used[row]
            self.price[self.rows] -= gain / used[row] * across
            self.price[row] += gain / used[row]
            self.inverse, self.rows, self.times = grown, np.append(self.rows, row), np.append(self.times, step)
            self.columns[:, k], self.left[row] = counts, 0
        else:
            pivot = self.inverse[old] / way[old]
            self.price[self.rows] += gain * pivot
            self.inverse -= np.outer(way, pivot)
            self.inverse[old] = pivot
            self.columns[:, old], self.times[old] = counts, step
        self.turns += 1
        if self.turns % self.REFACTOR == 0:
            self._refactor()
        return True

    def _refactor(self) -> None:
        """The basis anew, against rounding."""
        own = self.columns[:, : len(self.rows)]
        self.inverse = np.linalg.inv(own[self.rows])
        self.price = np.zeros(len(self.demand))
        self.price[self.rows] = self.capacity * self.inverse.sum(0)
        self.times = np.maximum(self.inverse @ self.demand[self.rows], 0)
        self.left = np.maximum(self.demand - own @ self.times, 0)
        self.left[self.rows] = 0


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = MAX_COLUMNS, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use them, of no length more than there is.

    Each round solves a linear program until no pattern pays, less than LEAST_LEFT of the ids is left over (which bounds
    the gain of any other pattern), max_columns went in, or the gain stays away. Counts are rounded down, then up where demand is left; what
    is left over then is the next round's demand.
    """
    left, chosen, total = demand.copy(), [], float(lengths @ demand)
    for _ in range(rounds):
        rows = np.flatnonzero(left > 0)
        if not len(rows) or lengths[rows] @ left[rows] <= LEAST_LEFT * total:
            break
        own, some = lengths[rows], left[rows]
        master = Master(some, capacity)
        entered, still, value = 1, 0, 0.0
        while entered and still < PATIENCE and master.turns < max_columns and own @ master.left > LEAST_LEFT * total:
            entered = sum(master.enter(counts) for counts in exact_fills(own, np.maximum(master.price, 0) + 1e-7 / some, capacity, 24))
            now = capacity * master.times.sum()
            still, value = (0, now) if now > value + 1e-3 * (own @ some) else (still + 1, value)
        patterns = master.columns[:, : len(master.rows)].T.astype(np.int64)
        progress = False
        whole = np.floor(master.times + 1e-9)
        for up in (False, True):
            for i in np.argsort(whole - master.times, kind="stable"):
                has = patterns[i] > 0
                most = int((some[has] // patterns[i][has]).min())
                times = min(most, 1) if up else min(most, int(whole[i]))
                if times > 0 and (not up or master.times[i] - whole[i] > 1e-6):
                    some = some - times * patterns[i]
                    counts = np.zeros(len(lengths), np.int64)
                    counts[rows] = patterns[i]
                    chosen.append((counts, times))
                    progress = True
        left[rows] = some
        if not progress:
            break
    return chosen


@dataclass(frozen=True)
class Layout:
    """Where each rank of each length goes; arrays by block, sorted by (length, base)."""

    capacity: int
    block_of: np.ndarray  # first block of each length, up to capacity + 1
    base: np.ndarray
    each: np.ndarray  # pieces of this length in a sequence; 0: laid end to end
    sequence: np.ndarray
    offset: np.ndarray
    ends: np.ndarray  # ends of the short sequences at the end of the laid ones
    whole: int  # laid sequences of full capacity
    laid_from: int

    @classmethod
    def of(cls, histogram: dict[int, int], capacity: int, max_columns: int) -> Layout:
        lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
        demand = np.array([histogram[n] for n in lengths], np.int64)
        chosen = solve(lengths, demand, capacity, max_columns)
        blocks = {int(n): [] for n in lengths}
        sequence = histogram.get(capacity, 0)
        used = np.zeros(len(lengths), np.int64)
        if sequence:
            blocks[capacity] = [(0, 1, 0, 0)]
        for counts, times in chosen:
            offset = 0
            for i in np.flatnonzero(counts):
                blocks[int(lengths[i])].append((int(used[i]), int(counts[i]), sequence, offset))
                offset += int(counts[i] * lengths[i])
                used[i] += counts[i] * times
            sequence += times
        at = 0
        for i, n in enumerate(lengths):
            blocks[int(n)].append((int(used[i]), 0, 0, at))
            at += int((demand[i] - used[i]) * n)
        rest, ends = at % capacity, []
        for bit in range(capacity.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                ends.append((ends[-1] if ends else 0) + (1 << bit))
        flat = [x for n in range(capacity + 1) for x in blocks.get(n, [])]
        first = np.cumsum([0] + [len(blocks.get(n, [])) for n in range(capacity + 1)])
        base, each, seq, off = (np.array([x[k] for x in flat], np.int64) for k in range(4))
        return cls(capacity, first, base, each, seq, off, np.array(ends, np.int64), at // capacity, sequence)

    def places(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, cut from, cut length, sequence, offset); rows that are laid end to end may give several."""
        block = np.zeros(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            low, high = self.block_of[n], self.block_of[n + 1]
            block[mine] = low + np.searchsorted(self.base[low:high], rank[mine], "right") - 1
        k = rank - self.base[block]
        each = self.each[block]
        fixed = np.flatnonzero(each > 0)
        turn, slot = k[fixed] // each[fixed], k[fixed] % each[fixed]
        yield fixed, np.zeros(len(fixed), np.int64), length[fixed], self.sequence[block[fixed]] + turn, self.offset[block[fixed]] + slot * length[fixed]
        row = np.flatnonzero(each == 0)
        at = self.offset[block[row]] + k[row] * length[row]
        left, cut = length[row].copy(), np.zeros(len(row), np.int64)
        edge = self.whole * self.capacity
        starts = np.concatenate([[0], self.ends])
        while len(row):
            tail = at >= edge
            number = np.where(tail, self.whole + np.searchsorted(self.ends, at - edge, "right"), at // self.capacity)
            start = np.where(tail, edge + starts[np.maximum(number - self.whole, 0)], number * self.capacity)
            end = np.where(tail, edge + (np.append(self.ends, 0))[np.maximum(number - self.whole, 0)], start + self.capacity)
            now = np.minimum(left, end - at)
            yield row, cut, now, self.laid_from + number, at - start
            more = left > now
            row, at, left, cut = row[more], (at + now)[more], (left - now)[more], (cut + now)[more]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece. capacity is a power of two."""
    if tokenizer is None:
        tokenizer, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    pieces = written(tokenised(docs, id_col, text_col, tokenizer, ranks, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    layout = Layout.of(histogram, capacity, max_columns)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: adds the partition and the rank within partition and length."""
        part, held, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first = seen if n == held else 0
                rank[mine] = first + np.arange(len(mine))
                last = first + len(mine)
                if n == length[-1]:
                    held_next, seen_next = int(n), last
            if len(length):
                held, seen = held_next, seen_next
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(length), pa.int32()), pa.array(rank)], [*batch.schema.names, "part", "local"])

    slim = pieces.select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    order = ["length", "doc_id", "start", "uid"]
    ranked = slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(numbered, "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local long")
    ranked = written(ranked, "ranked")
    counts = ranked.groupBy("length", "part").count().toPandas().sort_values(["length", "part"])  # at most partitions + capacity rows
    counts["before"] = counts.groupby("length")["count"].cumsum() - counts["count"]
    sent = spark.sparkContext.broadcast((layout, counts[["length", "part", "before"]]))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, counts = sent.value
        for batch in batches:
            df = batch.to_pandas()
            df["doc_id"] = batch.column(1).to_pandas(integer_object_nulls=True)
            rank = (df[["length", "part"]].merge(counts, "left", ["length", "part"])["before"] + df["local"]).to_numpy(np.int64)
            for row, cut, now, sequence, offset in layout.places(df["length"].to_numpy(np.int64), rank):
                some = df.iloc[row]
                whole = now == some["length"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some["uid"].to_numpy()), pa.array(list(some["doc_id"]), pa.int64()), pa.array(some["start"].to_numpy() + cut), pa.array(now), pa.array(some["ids_crc32"].to_numpy(), mask=~whole),
                        pa.array(some["doc_tokens"].to_numpy()), pa.array(sequence), pa.array(offset), pa.array(cut),
                    ], ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"],
                )

    schema = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut long"
    out = written(ranked.mapInArrow(placed, schema), "placed")

    @F.arrow_udf("long")
    def crc(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, cut, length in batches:
            yield pa.array([zlib.crc32(_wide(x.as_py())[c : c + n].tobytes()) for x, c, n in zip(ids, cut.to_pylist(), length.to_pylist(), strict=True)], pa.int64())

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    parts = out.where("ids_crc32 IS NULL").drop("ids_crc32").join(pieces.where("ids IS NOT NULL").select("uid", "ids"), "uid").withColumn("ids_crc32", crc("ids", "cut", "length"))
    return out.where("ids_crc32 IS NOT NULL").select(columns).unionByName(parts.select(columns))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
