"""Scoring of texts by a hierarchical Pitman-Yor language model.

Every word is the context of the word after it, and has a restaurant of its own: customers are the tokens seen after the
context, dishes are words. A table's dish comes from the parent restaurant, which all contexts share, as one customer
there; the parent's come from all words alike. Seating is sampled by Gibbs: in a sweep each dish of each restaurant has
its number of tables drawn from its conditional given the others, by generalised Stirling numbers
(carried on by their limit law beyond EXACT customers), then the parent's dishes given the tables of all
contexts, then the strengths from a grid by their likelihood. The other dishes' tables and the parent's probabilities are
those of the sweep before, so that dishes are independent of each other and no task needs a whole level. The probability
of a token is the mean over the samples after the burn-in; a text's score is the sum of the logarithms.

1. Tasks turn texts into (context, word) pairs of 64-bit hashes, add up equal ones of some megabytes of text, and send
   them to the part that a hash of the context names. A part holds about PART_BYTES of text. Contexts that would fill a
   part (found on one text in SAMPLE, which decides places only) are dealt by context and word; their few totals are
   added up by the driver.
2. A part makes restaurants of its pairs. Dishes with one customer have one table, so sweeps see the others alone.
3. Words ask for the parent's probability by a join on the word. After the sweeps all texts are sent again, now with the
   number of the text, and each part adds up what it knows of each text.

Tokens are runs of characters that are no ASCII white space, A-Z in lower case, then one end. Null texts are empty: the
end alone. Rows that repeat a document count and are scored each; a null id trains. An empty table gives an empty result;
without training rows every probability is 1. Long texts are taken whole, in memory one by one. Other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import functools
import gc
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._bytes import SPACE, U, blocks, mix, raw, trim, word_hashes
from finsift.llm._shared import crc_mod, keep_batches_small, read, release, written_at

END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
PART_BYTES, FLUSH_BYTES, SENT_BYTES, SAMPLE = 12 << 20, 10 << 20, 2 << 20, 64
EXACT = 512
GRID = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0)


@dataclass(frozen=True)
class Settings:
    burn_in: int = 1
    samples: int = 2
    seed: int = 42


# Arrays in binary columns


def small(x: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, that number first."""
    size = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
    return bytes((size,)) + x.astype(f"<u{size}").tobytes()


def wide(stored: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[0]}", offset=1)


def cells(table: pa.Table, *names: str) -> Iterator[list[pa.Buffer]]:
    """The rows of binary columns, not copied."""
    for batch in table.select(names).to_batches():
        for i in range(batch.num_rows):
            yield [x[i].as_buffer() for x in batch.columns]


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the number of each value among them, as np.unique has them in twice the memory."""
    order = np.argsort(x).astype(np.uint32)
    x = x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    values = x[new]
    del x
    number = np.empty(len(order), np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return values, number


# Texts to pairs


def pairs_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) of all tokens, each text's end included."""
    words, _, bounds = word_hashes(data, at, ~SPACE)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n + 1)
    w = np.full(len(words) + len(n), END, U)
    w[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[bounds[:-1] + np.arange(len(n))] = START
    return u, w, text


def joined(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of a pair."""
    return mix(u * U(0x9E3779B97F4A7C15) + w)


def place(u: np.ndarray, w: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    """The part of each pair."""
    key = mix(u)
    if len(hot):
        split = np.isin(u, hot)
        key[split] = joined(u[split], w[split])
    return ((key >> U(20)) % U(parts)).astype(np.int64)


def contexts_of(w: np.ndarray, text: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The contexts of some of the pairs whose words and texts follow each other in w and text."""
    before = np.maximum(some, 1) - some.dtype.type(1)
    u = w[before]
    u[(some == 0) | (text[before] != text[some])] = START
    return u


def _whole(blocks: list[np.ndarray]) -> np.ndarray:
    """The blocks as one array; they are let go."""
    x = np.concatenate(blocks)
    blocks.clear()
    trim()
    return x


def sent(docs: DataFrame, parts: int, hot: np.ndarray, with_texts: bool) -> DataFrame:
    """Pairs of docs (doc_id, text, held) by part, in binary columns, a row for each part and some megabytes of text.

    Each has the different contexts, how many pairs follow each, the different words, and of the pairs their word, number
    in training and in all; with texts, which texts hold a pair, once for each time. Texts have numbers from `first` on;
    the ids of some of them, of each text in one part alone, follow.
    """
    names = ["part", "contexts", "words", "pairs", "word", "trained", "times", "text", "used", "first", "owned", "ids", "held"]
    kinds = [pa.int32(), *[pa.binary()] * 8, pa.int64(), *[pa.binary()] * 3]

    def flushed(waiting: list[list[np.ndarray]], first_row: int) -> Iterator[pa.RecordBatch]:
        w, text, part, ids, held = map(_whole, waiting)
        ends = np.cumsum(np.bincount(part, minlength=parts))
        order = np.argsort(part, kind="stable").astype(np.uint32)
        del part
        out, size = [], 0
        # Part by part, so that but for the order nothing is made for all pairs at once.
        for p in range(parts):
            mine = order[ends[p - 1] if p else 0 : ends[p]]
            own = np.arange((p - first_row) % parts, len(ids), parts) if with_texts else np.zeros(0, np.int64)
            if not len(mine) and not len(own):
                continue
            pu, pw, pt = contexts_of(w, text, mine), w[mine], text[mine]
            by = np.argsort(joined(pu, pw))
            pu, pw, pt = pu[by], pw[by], pt[by]
            first = np.flatnonzero(np.concatenate([[True], (pu[1:] != pu[:-1]) | (pw[1:] != pw[:-1])])) if len(mine) else np.zeros(0, np.int64)
            trained = np.add.reduceat((~held[pt]).astype(np.int64), first) if len(mine) else first
            times = np.diff(np.append(first, len(mine)))
            x, xi = np.unique(pu[first], return_inverse=True)
            y, yi = np.unique(pw[first], return_inverse=True)
            by = np.argsort(xi, kind="stable")  # pairs by context
            n = times[by]
            more = [None] * 6
            if with_texts:
                used, texts = np.unique(pt[np.repeat(first[by] - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_inverse=True)
                more = [small(texts), small(used), first_row, small(own), ids[own].tobytes(), held[own].tobytes()]
            out.append((p, x.tobytes(), y.tobytes(), small(np.bincount(xi, minlength=len(x))), small(yi[by]), small(trained[by]), small(n), *more))
            size += sum(len(c) for c in out[-1] if isinstance(c, bytes))
            if len(out) == 16 or size > SENT_BYTES:
                yield _sent(out)
                size = 0
        if out:
            yield _sent(out)
        del w, text, order
        trim()

    def _sent(out: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, texts, start = [[] for _ in range(5)], 0, 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            data, at = raw(batch.column(1))
            ids = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in blocks(at):
                u, w, text = pairs_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                part = place(u, w, parts, hot)
                for kept, x in zip(waiting, (w, (text + texts).astype(np.uint32), part.astype(np.uint16) if parts < 1 << 16 else part, ids[i:j], held[i:j]), strict=True):
                    kept.append(x)
                texts, size = texts + j - i, size + int(at[j] - at[i])
                if size > FLUSH_BYTES:
                    yield from flushed(waiting, start)
                    start, size, texts = start + texts, 0, 0
        if waiting[0]:
            yield from flushed(waiting, start)
        trim()

    schema = ", ".join(f"{c} {'int' if c == 'part' else 'long' if c == 'first' else 'binary'}" for c in names)
    return docs.select("doc_id", "text", "held").mapInArrow(run, schema)


#: Stands for a null id in binary columns.
NO_ID = -(1 << 63)


def layout(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of parts, and contexts so frequent in a sample that they are dealt by word as well (at most 4 a part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known, n = 0, np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            data, at = raw(batch.column(1))
            total += len(data)
            some = np.flatnonzero((mix(np.arange(len(at) - 1).astype(U) + U(total)) % U(SAMPLE)) == 0)
            if len(some):
                data, at = raw(batch.column(1).take(pa.array(some)))
                u, _, _ = pairs_of(data, at)
                known, back = np.unique(np.concatenate([known, u]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, np.ones(len(u), np.int64)]), len(known)).astype(np.int64)
        often = n * 1000 > n.sum()  # at most 1000 a task
        yield pa.RecordBatch.from_arrays([pa.array([total, *[0] * int(often.sum())]), pa.array([int(n.sum()), *n[often].tolist()]), pa.array([None, *known[often].view(np.int64).tolist()], pa.int64())], ["bytes", "n", "context"])

    found = docs.select("doc_id", "text").mapInArrow(run, "bytes long, n long, context long")
    by = found.groupBy("context").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy(F.desc("n")).limit(4000).collect()  # the most frequent
    one = next((r for r in by if r["context"] is None), None)
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-(one["bytes"] if one else 0) // PART_BYTES))
    hot = [r["context"] for r in by if r["context"] is not None and r["n"] * 4 * parts > one["n"]]
    return parts, np.array(hot[: 4 * parts], np.int64).view(U)


@dataclass
class Pairs:
    """The pairs of a part, equal ones added up, in the order of their joined hashes."""

    u: np.ndarray
    w: np.ndarray
    trained: np.ndarray
    back: np.ndarray | None = None  # the pair of each row that was read

    @staticmethod
    def of(table: pa.Table) -> Pairs:
        n = [(len(x) - 1) // x[0] for (x,) in cells(table, "trained")]
        u, w, key, trained, a = *(np.empty(sum(n), U) for _ in range(3)), np.empty(sum(n), np.uint32), 0
        for k, r in zip(n, cells(table, "contexts", "words", "pairs", "word", "trained"), strict=True):
            u[a : a + k] = np.repeat(np.frombuffer(r[0], U), wide(r[2]))
            w[a : a + k] = np.frombuffer(r[1], U)[wide(r[3])]
            key[a : a + k] = joined(u[a : a + k], w[a : a + k])
            trained[a : a + k] = wide(r[4])
            a += k
        order = np.argsort(key).astype(np.uint32)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        del key
        first = np.flatnonzero(new)
        back = np.empty(len(new), np.uint32)
        back[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        some = order[first]
        return Pairs(u[some], w[some], np.add.reduceat(trained[order], first, dtype=np.int64) if len(first) else trained.astype(np.int64), back)


# Seating


@functools.cache
def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: the weight of all seatings of c customers at t tables, at [c, t]."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(most + 2)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = s[c] + np.log(np.maximum(c - d * t, 0))
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay[1:])
    return s


def weights(c: int, d: float) -> np.ndarray:
    """The logarithms, but for a constant, of the weights of 1, 2, .. tables for c customers.

    Beyond EXACT customers they are carried on from EXACT by their limit law: gamma(t) d^t times the weight depends on
    t / c^d alone (at three times EXACT the mean number of tables is within a tenth, where few are shared). So many tables
    as EXACT customers could have at that ratio are looked at.
    """
    table = log_stirling(d)
    if c <= EXACT:
        return table[c, 1 : c + 1]
    t = np.arange(1, EXACT + 1)
    law = table[EXACT, 1 : EXACT + 1] + log_gamma(t.astype(float)) + t * math.log(d)
    scale = (c / EXACT) ** d
    t = np.arange(1, int(EXACT * scale) + 1, dtype=float)
    return np.interp(t / scale, np.arange(1, EXACT + 1), law) - log_gamma(t) - t * math.log(d)


def drawn(c: np.ndarray, others: np.ndarray, h: np.ndarray, theta: float, d: float, uniform: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers, given the restaurant's other tables and the parent's probabilities h."""
    out = np.ones(len(c), np.int64)
    order = np.flatnonzero(c > 1)
    order = order[np.argsort(c[order], kind="stable")]
    sizes, edges = np.unique(c[order], return_index=True)
    edges = [*edges.tolist(), len(order)]
    for k, a, b in zip(sizes.tolist(), edges, edges[1:], strict=False):
        table = weights(k, d)
        t = np.arange(len(table))
        block = max(1, 200_000 // len(table))
        for some in (order[i : min(b, i + block)] for i in range(a, b, block)):
            weight = np.cumsum(np.log(theta + d * (others[some, None] + t)) + np.log(h[some, None]), 1) + table
            share = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            out[some] = 1 + (share < uniform[some, None] * share[:, -1:]).sum(1)
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after a shift by 8."""
    y = x + 8
    shift = np.log(x)
    for i in range(1, 8):
        shift += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def strength_likelihood(customers: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """For each strength of GRID, the logarithm of its factor in the likelihood of restaurants with such totals."""
    c, t = (x[customers > 0].astype(np.int64) for x in (customers, tables))
    # Equal totals are counted once: most restaurants are small.
    width = int(t.max(initial=0)) + 1
    both, n = np.unique(c * width + t, return_counts=True)
    c, t = (both // width).astype(float), (both % width).astype(float)
    one = np.ones(1)
    return np.array([float((n * ((t - 1) * math.log(d) + log_gamma(theta / d + t) - log_gamma(theta / d + one) - log_gamma(theta + c) + log_gamma(theta + one))).sum()) for theta in GRID])


def chosen(likelihood: np.ndarray, rng: np.random.Generator) -> float:
    weight = np.exp(likelihood - likelihood.max())
    return GRID[int(rng.choice(len(GRID), p=weight / weight.sum()))]


def discount(ones: int, twos: int) -> float:
    """From the numbers of dishes with one and with two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))


def opened(table: pa.Table, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Restaurants of a part: a row for each word that it holds, one with the dishes that sweeps see, those of hot contexts."""
    pairs = Pairs.of(table)
    pairs.back = None
    seen = np.flatnonzero(pairs.trained > 0)
    words, wi = numbered(pairs.w)
    pairs.w = None
    contexts, ui = numbered(pairs.u[seen])
    c, wi_seen = pairs.trained[seen], wi[seen]
    del pairs, wi, seen
    customers, dishes = np.bincount(ui, c, len(contexts)).astype(np.int64), np.bincount(ui, minlength=len(contexts))
    heavy = np.flatnonzero(c > 1)
    asked = np.unique(wi_seen[heavy])
    asks = np.zeros(len(words), bool)
    asks[asked] = True
    part = table.column("part")[0].as_py()
    n, types = np.bincount(wi_seen, c, len(words)).astype(np.int64), np.bincount(wi_seen, minlength=len(words))
    for i in range(0, len(words), 100_000):
        k = len(words[i : i + 100_000])
        yield _row([part] * k, words[i : i + k], n[i : i + k], types[i : i + k], asks[i : i + k])
    stored = [small(ui[heavy]), small(np.searchsorted(asked, wi_seen[heavy])), small(c[heavy]), small(customers), small(dishes), contexts.tobytes()]
    yield _row([part], [None], [int((c == 1).sum())], [int((c == 2).sum())], [None], [stored])
    mine = np.flatnonzero(np.isin(contexts, hot))
    if len(mine):
        yield _row([part] * len(mine), contexts[mine], customers[mine], dishes[mine], [None] * len(mine))


MADE = "part int, word long, n long, types long, asks boolean, stored array<binary>"


def _row(part, word, n, types, asks, stored=None) -> pa.RecordBatch:
    words = pa.array(word.view(np.int64)) if isinstance(word, np.ndarray) else pa.array(word, pa.int64())
    cells = [pa.array(part, pa.int32()), words, pa.array(n, pa.int64()), pa.array(types, pa.int64()), pa.array(asks, pa.bool_()), pa.array(stored if stored is not None else [None] * len(words), pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(cells, ["part", "word", "n", "types", "asks", "stored"])


def swept(seats: pa.Table, asked: pa.Table, theta: float, d: float, sweep: int, seed: int, hot: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """One sweep over a part: the new tables, tables beyond one by word, totals of hot contexts, likelihoods of strengths."""
    part, stored = seats.column("part")[0].as_py(), seats.column("stored")[0].as_py()
    ui, wi, c, customers, dishes, contexts = *(wide(x).astype(np.int64) for x in stored[:5]), np.frombuffer(stored[5], U)
    t = wide(stored[6]).astype(np.int64) if len(stored) > 6 else np.ones(len(c), np.int64)
    order = np.argsort(asked.column("word").to_numpy().view(U)) if asked.num_rows else np.zeros(0, np.int64)
    words, h = (asked.column("word").to_numpy().view(U)[order], asked.column("h").to_numpy()[order]) if asked.num_rows else (np.zeros(0, U), np.zeros(0))
    tables = dishes + np.bincount(ui, t - 1, len(dishes)).astype(np.int64)
    whole = tables.copy()
    mine = [i for i, u in enumerate(contexts.view(np.int64).tolist()) if u in hot] if hot else []
    for i in mine:
        whole[i] = hot[int(contexts[i].view(np.int64))][1]
    uniform = mix(joined(contexts[ui], words[wi]) + U((seed * 1000 + sweep) * 0x9E3779B97F4A7C15 % 2**64)).astype(float) / 2.0**64 if len(c) else np.zeros(0)
    t = drawn(c, whole[ui] - t, h[wi], theta, d, uniform)
    more = np.bincount(wi, t - 1, len(words)).astype(np.int64)
    tables = dishes + np.bincount(ui, t - 1, len(dishes)).astype(np.int64)
    alone = np.ones(len(dishes), bool)
    alone[mine] = False
    told = strength_likelihood(customers[alone], tables[alone], d)
    some = np.flatnonzero(more)
    yield _swept([part], [None], [0], [None], [[*stored[:6], small(t)]], [told.tolist()])
    if len(some):
        yield _swept([part] * len(some), words[some], more[some], [True] * len(some))
    if mine:
        yield _swept([part] * len(mine), contexts[mine], tables[mine], [False] * len(mine))


SWEPT = "part int, word long, n long, is_word boolean, stored array<binary>, likelihood array<double>"


def _swept(part, word, n, is_word, stored=None, told=None) -> pa.RecordBatch:
    words = pa.array(word.view(np.int64)) if isinstance(word, np.ndarray) else pa.array(word, pa.int64())
    cells = [pa.array(part, pa.int32()), words, pa.array(n, pa.int64()), pa.array(is_word, pa.bool_()), pa.array(stored or [None] * len(words), pa.list_(pa.binary())), pa.array(told or [None] * len(words), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cells, ["part", "word", "n", "is_word", "stored", "likelihood"])


def packed(rows):
    """The answers to a part's words in one row, in the order of the words."""
    order = np.argsort(rows.column("word").to_numpy().view(U))
    cells = [small(rows.column("n").to_numpy()[order]), *(rows.column(f"h{i}").to_numpy()[order].astype("<f4").tobytes() for i in range(len(rows.column_names) - 3))]
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "answers": pa.array([cells], pa.list_(pa.binary()))})


def part_scores(texts: pa.Table, known: pa.Table, thetas: list[float], d: float, hots: list[dict[int, tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """What a part knows of the texts of each bundle, in binary columns: the texts, tokens, known ones, base and score.

    One row a bundle, so that rows grow with bundles and not with texts times parts.
    """
    pairs = Pairs.of(texts)
    stored = {c: next((x for x in known.column(c).to_pylist() if x is not None), None) for c in ("answers", "stored")}
    counts = wide(stored["answers"][0]).astype(np.int64) if stored["answers"] else np.zeros(0, np.int64)
    words, at = numbered(pairs.w)  # those that were asked for
    assert len(words) == len(counts)
    u, trained, back = pairs.u, pairs.trained, pairs.back
    del pairs, words
    seen = np.flatnonzero(trained > 0).astype(np.uint32)
    contexts = np.unique(u[seen])
    own = np.minimum(np.searchsorted(contexts, u), max(0, len(contexts) - 1)).astype(np.uint32)
    inside = contexts[own] == u if len(contexts) else np.zeros(len(at), bool)
    del u
    c, ui = trained[seen], own[seen]
    del trained
    heavy = c > 1
    customers, dishes = np.bincount(ui, c, len(contexts)).astype(np.int64), np.bincount(ui, minlength=len(contexts))
    total = np.zeros(len(at))
    for s, theta in enumerate(thetas):
        h = np.frombuffer(stored["answers"][1 + s], "<f4").astype(float) if len(counts) else np.zeros(0)
        t = np.ones(len(seen), np.uint32)
        if heavy.any():
            t[heavy] = wide(stored["stored"][s])
        tables = dishes + np.bincount(ui, t - np.uint32(1), len(contexts)).astype(np.int64)
        whole = customers.copy()
        for i, u in enumerate(contexts.view(np.int64).tolist()) if hots[s] else ():
            if u in hots[s]:
                whole[i], tables[i] = hots[s][u]
        for i in range(0, len(at), SCORED):
            p, within = h[at[i : i + SCORED]], inside[i : i + SCORED]
            of = own[i : i + SCORED][within]
            p[within] = (theta + d * tables[of]) * p[within] / (theta + whole[of]) if len(of) else 0
            a, b = np.searchsorted(seen, np.array([i, i + SCORED], np.uint32))
            p[seen[a:b] - np.uint32(i)] += (c[a:b] - d * t[a:b]) / (theta + whole[ui[a:b]])
            total[i : i + SCORED] += p
    del own, inside, seen, c, ui, heavy
    total /= max(1, len(thetas))
    score, base = np.log10(total, out=total), np.log10(counts + 1.0)
    start = 0
    for first, (times, text, used, owned, ids, held) in zip(texts.column("first").to_pylist(), cells(texts, "times", "text", "used", "owned", "ids", "held"), strict=True):
        times, text, used, owned = (wide(x) for x in (times, text, used, owned))
        each = np.repeat(back[start : start + len(times)], times)
        start += len(times)
        sums = [np.bincount(text, x, len(used))[: len(used)] for x in (None, counts[at[each]] > 0, base[at[each]], score[each])]
        told = [small(used), *(small(x.astype(np.int64)) for x in sums[:2]), *(x.astype("<f8").tobytes() for x in sums[2:]), small(owned), ids.to_pybytes(), held.to_pybytes()]
        yield pa.RecordBatch.from_arrays([pa.array([first]), *(pa.array([x], pa.binary()) for x in told)], ["first", *TOLD])
    del back, at, score, total
    trim()


#: Pairs that are scored at once.
SCORED = 1 << 16
TOLD = ["used", "tokens", "known", "base", "score", "owned", "ids", "held"]


def gathered(bundle):
    """(doc_id, held_out, n_tokens, n_known, base, score) of a bundle's texts, from all parts that know of them."""
    rows = [[wide(x).astype(np.int64) if i in (0, 1, 2, 5) else np.frombuffer(x, ("<f8", "<f8", None, "<i8", "?")[i - 3]) for i, x in enumerate(r)] for r in zip(*(bundle.column(c).to_pylist() for c in TOLD), strict=True)]
    n = 1 + max((int(r[5].max()) for r in rows if len(r[5])), default=-1)
    ids, held = np.full(n, NO_ID), np.zeros(n, bool)
    for r in rows:
        ids[r[5]], held[r[5]] = r[6], r[7]
    used = np.concatenate([r[0] for r in rows])
    tokens, known, base, score = (np.bincount(used, np.concatenate([r[i] for r in rows]), n) for i in range(1, 5))
    cells = [pa.array(ids, mask=ids == NO_ID), pa.array(held), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
    return pa.table(cells, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])


def _freed(spark: SparkSession) -> None:
    """Lets Spark delete shuffles that nothing needs any more: it does so some time after the driver's collection."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows where held is true don't train."""
    spark = docs.sparkSession
    keep_batches_small(spark)  # also while the caller writes the result, which sends whole texts once more
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    parts, hot = layout(given)
    rng = np.random.default_rng(settings.seed)

    def open_(key, table):
        out = pa.Table.from_batches(list(opened(table, hot)))
        trim()
        return out

    made, made_path = written_at(sent(given, parts, hot, False).groupBy("part").applyInArrow(open_, MADE), "restaurants")
    _freed(spark)
    uses = made.where("asks IS NOT NULL").select("part", "word", "n", "types", "asks")
    first = made.where("stored IS NOT NULL")
    seats = first.select("part", "stored")
    by_word, words_path = written_at(uses.groupBy("word").agg(F.sum("n").alias("n"), F.sum("types").alias("types")), "words")
    one = by_word.agg(F.sum("n"), F.count_if(F.expr("n > 0")), F.sum("types"), F.count_if(F.expr("types = 1")), F.count_if(F.expr("types = 2"))).first()
    n, v, customers = one[0] or 0, one[1], one[2] or 0
    few = first.agg(F.sum("n"), F.sum("types")).first()  # dishes with one and with two customers
    d, d_parent, h_base = discount(few[0] or 0, few[1] or 0), discount(one[3], one[4]), 1 / (v + 1)
    theta = theta_parent = 1.0
    totals = lambda df, c: {r[0]: (r[1], r[2]) for r in df.groupBy("word").agg(F.sum("n"), F.sum(c)).collect()}  # noqa: E731  at most 4 a part
    hot_now = totals(made.where("asks IS NULL AND word IS NOT NULL"), "types") if len(hot) else {}
    words = by_word.select("word", "n", "types", F.col("types").alias("c"), F.least("types", F.lit(1)).cast("long").alias("t"))
    words_t, old = v, []
    parent = lambda t, theta, c: (F.col("c") - F.lit(d_parent) * F.col("t") + F.lit((theta + d_parent * t) * h_base)) / F.lit(theta + c)
    samples, thetas, hots, asked = [], [], [], []
    for sweep in range(settings.burn_in + settings.samples):
        answers = uses.where("asks").select(F.col("part").alias("of"), "word").join(words.select("word", parent(words_t, theta_parent, customers).alias("h")), "word")
        done, path = written_at(seats.groupBy("part").cogroup(answers.groupBy("of")).applyInArrow(_sweeper(theta, d, sweep, settings.seed, hot_now), SWEPT), "swept")
        seats = done.where("stored IS NOT NULL").select("part", "stored")
        likelihood = done.where("likelihood IS NOT NULL").select(*(F.sum(F.col("likelihood")[i]).alias(f"l{i}") for i in range(len(GRID)))).first()
        likelihood = np.array([x or 0.0 for x in likelihood])
        if hot_now:
            now = {r[0]: r[1] for r in done.where("NOT is_word").groupBy("word").agg(F.sum("n")).collect()}  # at most 4 a part
            hot_now = {u: (c, now[u]) for u, (c, _) in hot_now.items()}
            likelihood += strength_likelihood(*np.array(list(hot_now.values())).T, d)
        theta = chosen(likelihood, rng)
        more = done.where("is_word").groupBy("word").agg(F.sum("n").alias("more"))
        moved = words.select("word", "n", "types", F.col("t").alias("before"), *samples).join(more, "word", "left").withColumn("c", F.col("types") + F.coalesce("more", F.lit(0).cast("long"))).drop("more")
        words, new = written_at(_reseated(moved, words_t, h_base, theta_parent, d_parent, settings.seed * 1000 + sweep), "words")
        sums = words.agg(F.sum("c"), F.sum("t")).first()
        customers, words_t = sums[0] or 0, sums[1] or 0
        theta_parent = chosen(strength_likelihood(np.array([customers]), np.array([words_t]), d_parent), rng)
        if sweep >= settings.burn_in:
            thetas.append(theta)
            hots.append(hot_now)
            asked.append(done.where("stored IS NOT NULL").select("part", F.col("stored")[6].alias("t"), F.lit(len(thetas)).alias("sample")))
            words = words.withColumn(f"h{len(samples)}", parent(words_t, theta_parent, customers))
            samples.append(f"h{len(samples)}")
        old.append(path)
        release(spark, words_path)
        words_path = new
        _freed(spark)
    tables = functools.reduce(DataFrame.unionByName, asked).groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "t"))), lambda x: x["t"]).alias("stored"))
    replies = uses.select("part", "word").join(words.select("word", "n", *samples), "word").groupBy("part").applyInArrow(packed, "part int, answers array<binary>")
    known = written_at(replies.join(tables, "part", "left"), "known")[0]
    del replies, tables, asked, words, uses, made, first, seats, done, by_word, moved, more, answers
    release(spark, words_path, made_path, *old)
    _freed(spark)

    def final(key, texts, told):
        return pa.Table.from_batches(list(part_scores(texts, told, thetas, d, hots)))

    partial = sent(given, parts, hot, True).groupBy("part").cogroup(known.groupBy("part")).applyInArrow(final, "first long, " + ", ".join(f"{c} binary" for c in TOLD))
    out = partial.groupBy("first").applyInArrow(gathered, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), "score")


def _sweeper(theta: float, d: float, sweep: int, seed: int, hot: dict[int, tuple[int, int]]):
    def run(key, seats, asked):
        return pa.Table.from_batches(list(swept(seats, asked, theta, d, sweep, seed, hot)))

    return run


def _reseated(words: DataFrame, tables: int, h: float, theta: float, d: float, seed: int) -> DataFrame:
    """words (.., c, before) with t, the parent's tables of each word, in place of those before; tables: of all words."""
    at, held = words.columns.index("c"), words.columns.index("before")
    names = [c for c in words.columns if c != "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, before = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, held))
            uniform = mix(batch.column(0).to_numpy(zero_copy_only=False).view(U) + U(seed * 0x9E3779B97F4A7C15 % 2**64)).astype(float) / 2.0**64
            t = drawn(c, tables - before, np.full(len(c), h), theta, d, uniform)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != held), pa.array(np.where(c > 0, t, 0))], [*names, "t"])

    return words.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in words.select(names).dtypes) + ", t long")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, crc_mod("doc_id", 7) == 2)
