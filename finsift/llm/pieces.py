"""SentencePiece encoding and decoding of a merge-type (BPE) model, with seeded merge-dropout.

A text is split where no piece of the model reaches across (found by looking at the vocabulary), and each part's
characters are merged by an agenda: the pair whose merged piece scores best goes first, of equal ones the leftmost.
With dropout, a candidate merge is skipped where a hash keyed by seed, document, place in the text and pieces falls below
the rate. So a seed gives the same segmentation on every run and cluster, other seeds give others, and every occurrence
of a word is segmented on its own, within a document and between documents. Without dropout the pieces are the model's.

All parts of a block of texts are merged at once: parts of like length are the columns of a matrix, and in every round
each part does the best merge on its agenda. No outcome is remembered or reused. Parts over LONG characters have a heap
each. Memory is a few arrays of the size of a block, or of one text where that is longer.

Decoding gives back the text exactly: characters that the vocabulary lacks, and the blank mark itself where a text
holds it, are byte pieces. A null text stays null; an empty one has no pieces. Rows are independent of each other, but
for their ids, a null id being document 0; repeated rows get equal pieces. An empty table gives an empty result. Added
columns replace columns of the same name.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._bytes import U, blocks, mix, raw
from finsift.llm._shared import fresh, read

MARK = "▁"
#: Widths of the matrices; longer parts have a heap each.
WIDTHS = (3, 5, 7, 9, 12, 16, 24, 48)
LONG = WIDTHS[-1]
PAIR, PLACE = 0x1F123BB5, 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
#: A symbol that was merged into the one before it, and a merge that is none.
GONE = -(1 << 31)
NEVER = (1 << 31) - 1


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in normal}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.n = n
        self.score = np.array([sp.get_score(i) for i in range(n)])
        pairs = {}
        for i in normal:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.pairs = pairs
        # Ids of characters by code point, below 0 for those that the vocabulary lacks; a blank is the mark.
        self.character = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.character[ord(p)] = i
        self.character[ord(" ")] = self.character[ord(MARK)]
        # The spelling of each id, one after the other.
        spelled = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            spelled[i] = bytes((b,))
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.edges = np.cumsum([0, *map(len, spelled)])
        self._index()
        # Where parts may be cut: before a blank mark that follows something else, and around line ends.
        self.inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.lines = any("\n" in p and len(p) > 1 for p in self.id)

    def _index(self) -> None:
        """An open table of the pairs: key, and place in the arrays of merged piece, rank and mixed pair."""
        key = np.array(sorted(self.pairs), np.int64)
        self.merged = np.array([self.pairs[k] for k in key.tolist()], np.int32)
        _, rank = np.unique(-self.score[self.merged], return_inverse=True)  # equal scores have equal ranks
        self.rank = rank.astype(np.int64)
        self.mixed = mix((key // self.n).view(U) * U(PAIR) + (key % self.n).view(U))
        self.bits = max(4, (4 * len(key)).bit_length())
        self.table, self.entry = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, open_ = self._slot(key), np.arange(len(key))
        while len(open_):
            free = open_[self.table[slot[open_]] < 0]
            self.table[slot[free]] = key[free]  # of several, one stays
            self.entry[slot[free]] = free
            open_ = open_[self.entry[slot[open_]] != open_]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(PLACE)) >> U(64 - self.bits)).astype(np.int64)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of ids can merge, and their places in the pairs' arrays."""
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at].astype(np.int64) * self.n + right[at]
        slot = self._slot(key)
        held = self.table[slot]
        hit = held == key
        open_ = np.flatnonzero(~hit & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.table[slot[open_]]
            hit[open_] = held == key[open_]
            open_ = open_[(held >= 0) & (held != key[open_])]
        return at[hit], self.entry[slot[hit]]

    def symbols(self, part: str) -> list[int]:
        """Ids of the characters; below 0 for those that the vocabulary lacks."""
        return self.character[np.frombuffer(part.encode("utf-32-le"), np.uint32)].tolist()

    def spelled_out(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with missing characters as byte pieces, and the number of ids that each became."""
        count = np.ones(len(ids), np.int64)
        missing = np.flatnonzero(ids < 0)
        if not len(missing):
            return ids, count
        own = {x: [self.bytes[b] for b in chr(-1 - x).encode()] for x in np.unique(ids[missing]).tolist()}
        count[missing] = [len(own[x]) for x in ids[missing].tolist()]
        out = np.repeat(ids, count)
        at = np.cumsum(count) - count
        for i, x in zip(at[missing].tolist(), ids[missing].tolist(), strict=True):
            out[i : i + len(own[x])] = own[x]
        return out, count

    def spelled(self, ids: list[int]) -> list[int]:
        return self.spelled_out(np.array(ids, np.int64))[0].tolist()

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose ids begin at at, without each text's first blank, and their offsets."""
        begin, size = self.edges[ids], self.edges[ids + 1] - self.edges[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        data = self.spelling[np.repeat(begin - end[:-1], size) + np.arange(end[-1])]
        edge = end[at]
        keep = np.ones(len(data), bool)
        keep[edge[:-1][np.diff(edge) > 0]] = False
        return data[keep], np.concatenate([[0], np.cumsum(np.maximum(np.diff(edge) - 1, 0))])

    def decode(self, ids: list[int]) -> str:
        """The text of encode()'s ids."""
        return self.decoded(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8")


def bound_of(rate: float) -> int:
    """A candidate is skipped if its hash is below."""
    return min(M64, math.ceil(rate * (1 << 53)) << 11) if rate > 0 else 0


def mixed(x: int) -> int:
    """mix() of one number."""
    x &= M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def by_agenda(m: PieceModel, symbols: list[int], key: int, rate: float, base: int = 0) -> list[int]:
    """One part, that begins at place base of its text, by a heap of candidate merges."""
    n, bound = len(symbols), bound_of(rate)
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and ids[i] >= 0 and ids[j] >= 0:
            to = m.pairs.get(ids[i] * m.n + ids[j])
            if to is not None and mixed(mixed(ids[i] * PAIR + ids[j]) + (base + i) * PLACE + key) >= bound:
                heapq.heappush(heap, (-m.score[to], i, ids[i], ids[j], to))

    for i in range(n - 1):
        offer(i)
    gone = [False] * (n + 1)
    while heap:
        _, i, a, b, to = heapq.heappop(heap)
        if gone[i] or ids[i] != a or after[i] >= n or ids[after[i]] != b:
            continue
        j = after[i]
        ids[i], gone[j], after[i] = to, True, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ids[i] for i in range(n) if not gone[i]]


def merge_columns(m: PieceModel, symbols: np.ndarray, place: np.ndarray, key: np.ndarray, bound: int) -> np.ndarray:
    """The columns of symbols (-1 below a part's end), each a part, after all merges; merged symbols are GONE.

    place and key: of each part. In every round each part does the best merge on its agenda, the leftmost of equal ones.
    """
    width, n = symbols.shape
    out = np.empty_like(symbols)
    column = np.arange(n)
    # One more row stands for the end of each part and for what is before its first symbol.
    sym = np.vstack([symbols, np.full((1, n), -1, symbols.dtype)])
    after = np.repeat(np.arange(1, width + 2)[:, None], n, 1)
    before = np.repeat(np.array([width, *range(width)])[:, None], n, 1)
    agenda, to = np.full((width + 1, n), NEVER, np.int64), np.zeros((width + 1, n), np.int32)

    def offer(left, right, i, part, at) -> None:
        """Puts the candidates (at rows i of the columns part, places at in the arrays) on the agenda, or takes them off."""
        agenda.reshape(-1)[at] = NEVER
        some, entry = m.candidates(left, right)
        i, part, at = i[some], part[some], at[some]
        if bound:
            h = mix(m.mixed[entry] + (place[part] + i).view(U) * U(PLACE) + key[part])
            live = h >= U(bound)
            i, at, entry = i[live], at[live], entry[live]
        agenda.reshape(-1)[at] = m.rank[entry] << 8 | i
        to.reshape(-1)[at] = m.merged[entry]

    i, part = np.divmod(np.arange((width - 1) * n), max(n, 1))
    offer(sym[: width - 1].reshape(-1), sym[1:width].reshape(-1), i, part, np.arange((width - 1) * n))
    while n:
        best = agenda.min(0)
        part = np.flatnonzero(best < NEVER)
        if len(part) < n * 3 // 4 or not len(part):
            over = np.flatnonzero(best >= NEVER)
            out[:, column[over]] = sym[:width, over]
            sym, after, before, agenda, to = (x.take(part, 1) for x in (sym, after, before, agenda, to))
            column, place, key, best = column[part], place[part], key[part], best[part]
            n, part = len(part), np.arange(len(part))
            if not n:
                break
        s, a, b = sym.reshape(-1), after.reshape(-1), before.reshape(-1)
        i = best[part] & 255
        at = i * n + part
        new = to.reshape(-1)[at]
        gone = a[at] * n + part
        follower = a[gone]
        next_at = follower * n + part
        s[at], s[gone] = new, GONE
        a[at], b[next_at] = follower, i
        agenda.reshape(-1)[gone] = NEVER
        ahead = b[at]
        ahead_at = ahead * n + part
        offer(np.concatenate([new, s[ahead_at]]), np.concatenate([s[next_at], new]), np.concatenate([i, ahead]), np.concatenate([part, part]), np.concatenate([at, ahead_at]))
    return out


def together(m: PieceModel, parts: list[list[int]], key: int, rate: float) -> list[list[int]]:
    """Many short parts at once, each at the start of a text."""
    size = np.array([len(p) for p in parts])
    symbols = np.full((int(size.max()), len(parts)), -1, np.int32)
    for j, p in enumerate(parts):
        symbols[: len(p), j] = p
    zero = np.zeros(len(parts), np.int64)
    made = merge_columns(m, symbols, zero, zero.view(U) + U(key & M64), bound_of(rate))
    return [[x for x in made[: len(p), j].tolist() if x != GONE] for j, p in enumerate(parts)]


@functools.cache
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """The same seed, rate, document and text always give the same ids."""

    def __init__(self, m: PieceModel, seed: int, rate: float):
        self.m, self.seed, self.rate = m, seed, rate

    def keys(self, documents: list[int] | np.ndarray) -> np.ndarray:
        return mix(np.array(documents, np.int64).view(U) + U(self.seed * 0x10001 & M64))

    def _marked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points with a blank before each text that isn't empty, where texts begin, and which are marks of a text itself."""
        data, _ = raw(texts)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size + (size > 0))])
        out = np.full(at[-1], ord(" "), np.uint32)
        rest = np.ones(at[-1], bool)
        rest[at[:-1][size > 0]] = False
        out[rest] = points
        return out, at, out == ord(MARK)

    def _starts(self, points: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Where parts begin."""
        first = np.zeros(len(points) + 1, bool)
        first[at] = True
        first[:-1] |= own
        first[1:] |= own
        if not self.m.inner:
            blank = points == ord(" ")
            first[:-1] |= blank
            first[1:-1] &= ~(blank[1:] & blank[:-1]) | own[:-1]
            first[at] = True
            if not self.m.lines:
                line = points == ord("\n")
                first[:-1] |= line
                first[1:] |= line
        return np.flatnonzero(first[:-1])

    def split(self, text: str) -> list[str]:
        """Parts of the marked text; a mark in the text itself is a part of its own, kept apart by a leading NUL."""
        points, at, own = self._marked(pa.array([text], pa.string()))
        start = self._starts(points, at, own).tolist()
        whole = points.astype("<u4").tobytes().decode("utf-32-le").replace(" ", MARK)
        return [("\0" if own[i] else "") + whole[i:j] for i, j in zip(start, [*start[1:], len(whole)], strict=True)]

    def arrays(self, texts: pa.Array, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and n + 1 offsets; a null is an empty text."""
        m, bound = self.m, bound_of(self.rate)
        points, at, own = self._marked(texts)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        ids = m.character[points]
        ids[own] = -1 - ord(MARK)
        start = self._starts(points, at, own)
        size = np.diff(np.append(start, len(points)))
        text = np.searchsorted(at, start, "right") - 1
        marks = np.concatenate([[0], np.cumsum(own)])  # a mark of the text itself counts as two places
        place = start - at[text] + marks[start] - marks[at[text]]
        key = self.keys(documents)[text]
        low = 1  # parts of one symbol stay
        for width in WIDTHS:
            now = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(now):
                step = np.arange(width)[:, None]
                inside = step < size[now]
                where = np.minimum(start[now] + step, len(points) - 1)
                made = merge_columns(m, np.where(inside, ids[where], -1), place[now], key[now], bound)
                ids[where[inside]] = made[inside]
        for p in np.flatnonzero(size > LONG).tolist():
            i, j = int(start[p]), int(start[p] + size[p])
            made = by_agenda(m, ids[i:j].tolist(), int(key[p]), self.rate, int(place[p]))
            ids[i:j] = made + [GONE] * (j - i - len(made))
        stays = ids != GONE
        kept = np.concatenate([[0], np.cumsum(stays)])[at]
        out, count = m.spelled_out(ids[stays])
        return out, np.concatenate([[0], np.cumsum(count)])[kept]

    def encode(self, texts: list[str | None], documents: list[int]) -> list[list[int] | None]:
        ids, at = self.arrays(pa.array(texts, pa.string()), np.array(documents, np.int64))
        return [None if t is None else ids[i:j].tolist() for t, i, j in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def blocks(self, texts: pa.Array, documents: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(texts, ids, offsets), block by block."""
        documents = documents.to_numpy(zero_copy_only=False)
        for i, j in blocks(raw(texts)[1]):
            some = texts.slice(i, j - i)
            yield some, *self.arrays(some, documents[i:j])


def encode(docs: DataFrame, model_path: str | None = None, seed: int = 1, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of each text's pieces."""
    path = model_path or _default()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = Encoder(model_of(path), seed, rate)
        for texts, documents in batches:
            out = []
            for some, own, at in encoder.blocks(texts, documents):
                null = np.append(pc.is_null(some).to_numpy(zero_copy_only=False), False)
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=null), pa.array(own, pa.int32())))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(to, ids(F.col(f"`{text_col}`"), document_of(id_col)))


def document_of(id_col: str):
    return F.when(F.col(f"`{id_col}`").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(f"`{id_col}`").cast("string")))


def decode(docs: DataFrame, model_path: str | None = None, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text that encode()'s ids stand for."""
    path = model_path or _default()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model_of(path)
        for lists in batches:
            yield pa.array([None if x is None else m.decode(x) for x in (y.as_py() for y in lists)], pa.string())

    return docs.withColumn(to, text(F.col(f"`{ids_col}`")))


def _default() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def lossless(m: PieceModel, texts: pa.Array, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text is what its ids decode to."""
    (data, edge), (told, told_edge) = raw(texts), m.decoded(ids, at)
    same = np.diff(edge) == np.diff(told_edge)
    if same.all():
        wrong = np.concatenate([[0], np.cumsum(data != told)])
        return wrong[edge[1:]] == wrong[edge[:-1]]
    return np.array([bool(ok) and bool((data[i:j] == told[k : k + j - i]).all()) for ok, i, j, k in zip(same, edge[:-1], edge[1:], told_edge, strict=False)])


def digests(docs: DataFrame, model_path: str | None = None, seed: int = 1, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", to: str = "pieces") -> DataFrame:
    """docs with (n_pieces, ids_crc32, lossless): encodes and decodes each text without sending its ids around."""
    path = model_path or _default()
    kind = pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])

    @F.arrow_udf("n_pieces long, ids_crc32 long, lossless boolean")
    def told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = model_of(path)
        encoder = Encoder(m, seed, rate)
        for texts, documents in batches:
            out = []
            for some, ids, at in encoder.blocks(texts, documents):
                null = pc.is_null(some).to_numpy(zero_copy_only=False)
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out.append(pa.StructArray.from_arrays([pa.array(np.diff(at), pa.int64(), mask=null), pa.array(np.array(crc, np.int64), mask=null), pa.array(lossless(m, some, ids, at), mask=null)], fields=list(kind)))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    made = fresh([*docs.columns, to], "told")
    return docs.withColumn(made, told(F.col(f"`{text_col}`"), document_of(id_col))).drop(to).withColumnRenamed(made, to)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digests(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "pieces.n_pieces", "pieces.ids_crc32", "pieces.lossless")
