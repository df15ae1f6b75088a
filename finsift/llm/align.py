"""Alignment of two tokenizers' ids over the same texts, by a dangling-suffix transducer.

1. Of two tokenisations of the same bytes one is ahead by some bytes, the dangling suffix. The transducer's state is which
   side leads and that suffix; the next id of the side behind is its input. The suffix shrinks, or changes sides; where it
   is empty, both end together and a group closes. Transitions are remembered by state and id, so a step is a look-up.
2. Texts are cut where neither tokenizer's ids reach across: before a blank between two characters that are no white
   space. The parts' ids are found together, the transducer runs over them, and what it gives for a part is remembered
   too (as far as CACHE_BYTES go), for a text is mostly parts seen before. A second tokenizer whose pieces hold a blank
   after something else gets whole texts.
3. A link is the last id of either side in a group. Links are written by document, counted over all documents, and the
   counts looked up: in the tasks where the table has at most MAP_PAIRS pairs, else by a join. Both give the same rows.

Texts that are null or empty, and those that a side doesn't give back byte by byte (the second one takes U+2581 for a
blank), have no ids: zeros and an empty digest. Long texts are taken whole, ids of one text at a time in memory. Rows
that repeat a document count again; a null doc_id is a document like others. An empty table gives an empty result. Other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._bytes import blocks, raw, trim
from finsift.llm._shared import read, release, written_at

MARK = "▁"
#: Parts whose ids are found in one call, bytes of texts that are aligned together.
TOGETHER, TEXTS = 256, 1 << 20
#: Bytes of remembered parts and numbers of remembered transitions in a worker, at most; longer parts are not remembered.
CACHE_BYTES, MOVES, LONGEST = 72 << 20, 1 << 20, 256
#: Pairs of ids whose counts go to every task (16 bytes each), at most.
MAP_PAIRS = 4_000_000
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space beside a blank, or a blank at the end: such texts are cut by CUT.
ODD = re.compile(r"\s | \s| \Z")
#: Characters that both libraries of the first tokenizer are known to sort alike; other texts take the tokenizer file.
PLAIN = re.compile("[\x00-ɏ‐-›]*")

#: Groups as text, links, ids of either side.
Part = tuple[bytes, bytes, int, int]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """A byte-level tokenizer; with ranks of the same vocabulary, plain texts go through the faster library."""

    def __init__(self, path: str, ranks: str | None = None):
        import base64

        self.path = path
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        table = byte_level()
        vocab = said["model"]["vocab"]
        special = {x["content"] for x in said["added_tokens"]}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = piece.encode() if piece in special else bytes(table[c] for c in piece)
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def ids(self, part: str) -> list[int]:
        if self.fast is not None and PLAIN.fullmatch(part):
            return self.fast.encode_ordinary(" " + part)
        return self.slow.encode(" " + part, add_special_tokens=False).ids


class PieceSide:
    """A sentencepiece model, which adds the first blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes((int(p[3:5], 16),)) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def ids(self, part: str) -> list[int]:
        return self.model.encode(part)


class Transducer:
    """Groups of two id sequences over the same bytes. State 0 is the empty suffix."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[bool, bytes], int] = {(False, b""): 0}
        self.suffix: list[tuple[bool, bytes]] = [(False, b"")]
        self.first: dict[int, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.known = 0

    def _state(self, leads: bool, suffix: bytes) -> int:
        """The number of a state; leads: whether the first side is ahead."""
        key = (leads and bool(suffix), suffix)
        if key not in self.states:
            self.states[key] = len(self.suffix)
            self.suffix.append(key)
            self.moves.append({})
        return self.states[key]

    def _after(self, leads: bool, suffix: bytes, said: bytes) -> int:
        """The state after the side behind has said some bytes; -1 where they differ."""
        self.known += 1
        if suffix.startswith(said):
            return self._state(leads, suffix[len(said) :])
        if said.startswith(suffix):
            return self._state(not leads, said[len(suffix) :])
        return -1

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """Where groups end, as numbers of ids of either side; None where the two spell different bytes."""
        if self.known > MOVES:
            self.clear()
        first, moves, suffix, width = self.first, self.moves, self.suffix, len(self.b)
        ends, others, i, j, n, m = [], [], 0, 0, len(a), len(b)
        while i < n and j < m:
            key = a[i] * width + b[j]
            state = first.get(key)
            if state is None:
                state = first[key] = self._after(True, self.a[a[i]], self.b[b[j]])
            i += 1
            j += 1
            while state > 0:
                leads = suffix[state][0]
                if (j >= m) if leads else (i >= n):
                    return None
                token = b[j] if leads else a[i]
                after = moves[state].get(token)
                if after is None:
                    after = moves[state][token] = self._after(*suffix[state], (self.b if leads else self.a)[token])
                state = after
                if leads:
                    j += 1
                else:
                    i += 1
            if state < 0:
                return None
            ends.append(i)
            others.append(j)
        return (ends, others) if i == n and j == m else None


class Aligner:
    """Groups and links of whole texts, part by part."""

    def __init__(self, first: ByteSide, second: PieceSide):
        self.first, self.second = first, second
        self.n_b = len(second.bytes)
        self.kind = np.dtype("<u4") if len(first.bytes) * self.n_b < 1 << 32 else np.dtype("<u8")
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (first, second)]
        self.transducer = Transducer(first.bytes, second.bytes)
        # Each id as text with the mark that can follow it: , or | on the first side, , or ; on the second.
        self.span = max(len(first.bytes), self.n_b)
        self.spelled = [f"{i}{mark}" for mark in ",|,;" for i in range(self.span)]
        self.spelled_length = np.array([len(x) for x in self.spelled], np.int64)
        self.cache: dict[str, Part | None] = {}
        self.held = 0

    def cut(self, text: str) -> list[str]:
        """The text's parts, each without the blank before it."""
        if self.second.whole:
            return [text]
        if ODD.search(text) or text[:1].isspace():
            parts = CUT.split(" " + text)
            return [parts[0][1:], *parts[1:]]
        return text.split(" ")

    def _parts(self, sides: list[list[int]], cuts: list[np.ndarray]) -> list[Part] | None:
        """(groups as text, links, ids of either side) of parts whose ids lie one after the other; cuts: where parts end.

        None where a side's bytes differ from the other's, or a part ends within a group.
        """
        told = self.transducer.groups(*sides)
        if told is None:
            return None
        a, b = (np.array(x, np.int64) for x in sides)
        ends, others = (np.array(x, np.int64) for x in told)
        last = np.searchsorted(ends, cuts[0])  # the group that ends with each part
        if len(cuts[0]) and not (len(ends) and last[-1] < len(ends) and (ends[last] == cuts[0]).all() and (others[last] == cuts[1]).all()):
            return None
        # All ids in the order of the groups, the first side's before the second's; each with the mark that follows it.
        order = np.zeros(len(a) + len(b), np.int64)
        lengths, others_before = np.diff(ends, prepend=0), np.concatenate([[0], others])[:-1]
        of_b = np.diff(others, prepend=0)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.full(len(b), 2)
        mark_a[ends - 1], mark_b[others - 1] = 1, 3
        order[np.arange(len(a)) + np.repeat(others_before, lengths)] = mark_a * self.span + a
        end_b = np.arange(len(b)) + np.repeat(ends, of_b)
        order[end_b] = mark_b * self.span + b
        said = "".join(map(self.spelled.__getitem__, order.tolist())).encode()
        stop = np.cumsum(self.spelled_length[order])[end_b[cuts[1] - 1]].tolist()
        links = (a[ends - 1] * self.n_b + b[others - 1]).astype(self.kind).tobytes()
        groups = ((last + 1) * self.kind.itemsize).tolist()
        n_a, n_b = (np.diff(c, prepend=0).tolist() for c in cuts)
        return [(said[x : y - 1], links[g:h], p, q) for x, y, g, h, p, q in zip([0, *stop[:-1]], stop, [0, *groups[:-1]], groups, n_a, n_b, strict=True)]

    def learn(self, parts: set[str]) -> dict[str, Part | None]:
        """What the transducer gives for parts: ids of simple ones are found together, as none reach across their blanks."""
        single = [p for p in parts if len(p) > LONGEST or p != p.strip() or not p or MARK in p]
        plain = [p for p in parts.difference(single) if p.isascii() or PLAIN.fullmatch(p)]
        found = {}
        for group in (plain, list(parts.difference(single, plain))):
            if not group:
                continue
            whole = [" ".join(group[i : i + TOGETHER]) for i in range(0, len(group), TOGETHER)]
            sides = [list(itertools.chain.from_iterable(map(side.ids, whole))) for side in (self.first, self.second)]
            ends = np.cumsum([len(p.encode()) + 1 for p in group])
            cuts = []
            for ids, lengths in zip(sides, self.lengths, strict=True):
                at = np.cumsum(lengths[np.array(ids, np.int64)])
                place = np.minimum(np.searchsorted(at, ends), len(at) - 1)
                cuts.append(place + 1 if (at[place] == ends).all() else None)
            rows = self._parts(sides, cuts) if all(c is not None for c in cuts) else None
            if rows is None:
                single += group
            else:
                found |= zip(group, rows, strict=True)
        for p in single:
            sides = [self.first.ids(p), self.second.ids(p)]
            rows = self._parts(sides, [np.array([len(x)]) for x in sides])
            found[p] = rows[0] if rows else None
        return found

    def texts(self, texts: list[str]) -> list[Part | None]:
        """(groups, links, ids of either side) of each text that isn't empty; None where a side doesn't give it back."""
        known = self.cache
        cut = [self.cut(t) for t in texts]
        new = self.learn(set(itertools.chain.from_iterable(cut)).difference(known))
        known |= new
        out: list[Part | None] = []
        for parts in cut:
            rows = list(map(known.__getitem__, parts))
            if None in rows:
                out.append(None)
            else:
                groups, links, n_a, n_b = zip(*rows, strict=True)
                out.append((b";".join(groups), b"".join(links), sum(n_a), sum(n_b)))
        for p, x in new.items():
            if len(p) > LONGEST:
                del known[p]
            else:
                self.held += 300 + len(p) + (len(x[0]) + len(x[1]) if x else 0)
        if self.held > CACHE_BYTES:  # parts that came back lately stay
            self.cache = {p: known[p] for p in set(itertools.chain.from_iterable(cut)).difference(new) if p in known}
            self.held = sum(300 + len(p) + (len(x[0]) + len(x[1]) if x else 0) for p, x in self.cache.items())
            if self.held > CACHE_BYTES // 2:
                self.cache, self.held = {}, 0
        return out


@functools.cache
def aligner(tokenizer: str, model: str, ranks: str | None) -> Aligner:
    return Aligner(ByteSide(tokenizer, ranks), PieceSide(model))


def aligned(docs: DataFrame, tokenizer: str, model: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", spelled: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, links) by document, with spelled also `groups` as text.

    links is binary, little-endian numbers a * (ids of the second side) + b in the order of the groups, each of 4 bytes,
    or of 8 where 4 don't hold all pairs. row is a number of its own for each row. ranks: see ByteSide.
    """
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", *["groups"] * spelled]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), *[pa.string()] * spelled]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(tokenizer, model, ranks), TaskContext.get().partitionId() << 40
        size = own.kind.itemsize
        for batch in batches:
            for i, j in blocks(raw(batch.column(1))[1], TEXTS):
                ids, texts = (batch.column(k).slice(i, j - i).to_pylist() for k in (0, 1))
                told = iter(own.texts([t for t in texts if t]))
                rows = []
                for doc_id, text in zip(ids, texts, strict=True):
                    one = next(told) if text else None
                    groups, links, a, b = one or (b"", b"", 0, 0)
                    said = hashlib.sha256(groups).hexdigest() if one else ""
                    rows.append((row, doc_id, a, b, len(links) // size, said, links, *[groups.decode()] * spelled))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        trim()

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", groups string" * spelled
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _links(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The links of a batch of documents, and n + 1 offsets."""
    held = [x.as_buffer() if x.is_valid else b"" for x in column]
    at = np.concatenate([[0], np.cumsum([len(h) // kind.itemsize for h in held], dtype=np.int64)])
    return np.frombuffer(b"".join(held), kind), at


def pair_counts(links: DataFrame, n_b: int, kind: str = "<u4", most: int = 1_000_000) -> DataFrame:
    """(pair, b, n, best) of all links: how often a pair is linked, and whether no other is more often with its b.

    Tasks add up what they read, up to `most` different pairs at a time, before rows are exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            codes, inverse = _factors(_links(batch.column(0), np.dtype(kind))[0])
            pairs, back = np.unique(np.concatenate([pairs, inverse.astype(np.int64)]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, np.bincount(codes, minlength=len(inverse))]), len(pairs)).astype(np.int64)
            if len(pairs) > most:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                pairs, n = pairs[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        trim()

    counts = links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % n_b)
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("pair", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _factors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code, and the different codes."""
    place, different = pd.factorize(codes)
    return place, np.asarray(different)


def scored(links: DataFrame, counts: DataFrame, kind: str = "<u4", map_pairs: int = MAP_PAIRS) -> DataFrame:
    """links (of aligned()) without links, with n_best and count_sum from the counts (a written table)."""
    spark = links.sparkSession
    names = [c for c in links.columns if c not in ("links", "row")]
    if counts.count() > map_pairs:
        return _scored_by_join(links, counts, kind, names)
    table = counts.select("pair", "n", "best").toPandas().sort_values("pair")  # at most map_pairs rows
    sent = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            codes, at = _links(batch.column(0), np.dtype(kind))
            place, different = _factors(codes)
            where = np.searchsorted(pairs, different.astype(np.int64))
            sums = [np.concatenate([[0], np.cumsum(x[where][place])]) if len(codes) else np.zeros(1, np.int64) for x in (best.astype(np.int64), n)]
            sums = [s[at[1:]] - s[at[:-1]] for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums[0]), pa.array(sums[1])], [*names, "n_best", "count_sum"])
        trim()

    schema = ", ".join(f"{c} {t}" for c, t in links.select(names).dtypes)
    return links.select("links", *names).mapInArrow(run, f"{schema}, n_best long, count_sum long")


def _scored_by_join(links: DataFrame, counts: DataFrame, kind: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = _links(batch.column(1), np.dtype(kind))
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            place, different = _factors(codes)
            both, times = np.unique(owner * max(1, len(different)) + place, return_counts=True)
            rows = batch.column(0).take(pa.array(both // max(1, len(different))))
            yield pa.RecordBatch.from_arrays([rows, pa.array(different.astype(np.int64)[both % max(1, len(different))]), pa.array(times)], ["row", "pair", "times"])

    each = links.select("row", "links").mapInArrow(run, "row long, pair long, times long").join(counts, "pair")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return links.drop("links").join(sums, "row", "left").select(*names, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, model, ranks = (vocabulary(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    own = aligner(tokenizer, model, ranks)
    links, _ = written_at(aligned(read(spark, sf_dir, "documents"), tokenizer, model, ranks), "links")
    counts, path = written_at(pair_counts(links, own.n_b, own.kind.str), "counts")
    out = scored(links, counts, own.kind.str)
    if counts.count() <= MAP_PAIRS:
        release(spark, path)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
