"""Reversible line deduplication: sharded cuckoo filters in front of exact reference tables.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of at least
min_chars code points held by at least min_docs documents is frequent: all its lines go, but for those in the
largest doc_id that holds it. `LineIndex` keeps

* holders(key, doc_id): every reference, exact, each once: a table, and one more of the references or of the deleted
  ids of each change since, until LAYERS of them are written as one;
* frequent(key, n_docs, max_doc): the reference counts that reached min_docs;
* filters(shard, buckets): a cuckoo filter of each shard's frequent keys, from which keys can be deleted.

Of the last two, too, a change writes only the keys and shards that it touches.

insert() and delete() touch only the keys of the documents given; a deleted document's lines come back in the
others. Every new state is a set of tables in the shared folder, so a lost executor costs a re-read only.

Null or empty texts are one empty line, and stay empty. Rows that repeat a doc_id are one document when holders are
counted, and each is cleaned. Rows without a doc_id hold no reference and lose no line. Lines of any length and
number are handled; an empty table gives an empty result. Added columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._bytes import U, mix, trim
from finsift.llm._shared import fresh, read, written

MIN_CHARS, MIN_DOCS = 40, 5
SLOTS = 4
SHARD_KEYS = 1 << 15
#: Up to so many frequent keys (24 bytes each) the exact table goes to every executor; beyond, it is joined.
MAP_SIDE_KEYS = 1 << 20
#: Changes to the references that are kept as tables of their own before all are written as one.
LAYERS = 16
#: Up to so many bytes the filters go to every executor; beyond, the join has no filter before it.
FILTER_BYTES = 64 << 20
_TRIM = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The digest of a line's key; None for shorter keys."""
    line = line.strip(_TRIM)
    return hashlib.md5(line.encode("utf-8", "replace").lower(), usedforsecurity=False).digest() if len(line) >= min_chars else None


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key's second bucket follows from its first and its fingerprint."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 1
        while n * SLOTS * 0.8 < keys + 1:
            n *= 2
        return cls(np.zeros((n, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        out = cls.sized(len(keys))
        while not all(out.insert(k) for k in keys):
            out = cls(np.zeros((2 * len(out.buckets), SLOTS), np.uint16))
        return out

    @classmethod
    def read(cls, stored: bytes) -> CuckooFilter:
        return cls(np.frombuffer(stored, np.uint16).reshape(-1, SLOTS).copy())

    def stored(self) -> bytes:
        return self.buckets.tobytes()

    def _place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words: two uint64 a key."""
        mark = (words[:, 1] % U(65535) + U(1)).astype(np.uint16)
        mask = U(len(self.buckets) - 1)
        one = (mix(words[:, 0]) & mask).astype(np.int64)
        return mark, one, one ^ self._other(mark)

    def _other(self, mark: np.ndarray) -> np.ndarray:
        return (mix(mark.astype(U)) & U(len(self.buckets) - 1)).astype(np.int64)

    def insert(self, key: bytes) -> bool:
        mark, one, two = (x[0] for x in self._place(np.frombuffer(key, U).reshape(1, 2)))
        for at in (one, two):
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = mark
                return True
        before, at = self.buckets.copy(), one
        for turn in range(500):
            slot = turn % SLOTS
            mark, self.buckets[at, slot] = self.buckets[at, slot], mark
            at ^= int(self._other(np.array([mark]))[0])
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = mark
                return True
        self.buckets = before
        return False

    def delete(self, key: bytes) -> bool:
        mark, one, two = (x[0] for x in self._place(np.frombuffer(key, U).reshape(1, 2)))
        for at in (one, two):
            held = np.flatnonzero(self.buckets[at] == mark)
            if len(held):
                self.buckets[at, held[0]] = 0
                return True
        return False

    def may_hold(self, words: np.ndarray) -> np.ndarray:
        mark, one, two = self._place(words)
        return ((self.buckets[one] == mark[:, None]) | (self.buckets[two] == mark[:, None])).any(1)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words[:, 0] >> U(20)) % U(shards)).astype(np.int64)


class Probe:
    """Filters by shard, and the exact table if it was small enough to send."""

    def __init__(self, filters: dict[int, bytes], shards: int, keys: np.ndarray | None, max_doc: np.ndarray | None):
        self.filters, self.shards = filters, shards
        self.keys, self.max_doc = keys, max_doc

    def opened(self) -> Probe:
        out = Probe({s: CuckooFilter.read(b) for s, b in self.filters.items()}, self.shards, self.keys, self.max_doc)
        out.exact = dict(zip(map(bytes, self.keys), self.max_doc.tolist(), strict=True)) if self.keys is not None else None
        return out

    def maybe(self, digests: list[bytes]) -> np.ndarray:
        words = np.frombuffer(b"".join(digests), U).reshape(-1, 2)
        shard = shard_of(words, self.shards)
        out = np.zeros(len(words), bool)
        for s in np.unique(shard):
            if s in self.filters:
                mine = shard == s
                out[mine] = self.filters[s].may_hold(words[mine])
        return out


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    return [line_key(x, min_chars) for x in (text or "").split("\n")]


def _holders(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    @F.arrow_udf("array<binary>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([list({k for k in keys_of(t.as_py(), min_chars) if k}) for t in texts], pa.list_(pa.binary()))
        trim()

    found = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(keys(F.col(f"`{text_col}`"))).alias("key"))
    return found.distinct()


def _built(shards: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "buckets": [CuckooFilter.of([bytes(k) for k in pdf["key"]]).stored()]})

    return build


def _updated(before: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after deletions and insertions; buckets null if it is full and must be rebuilt."""
    shard = int((before if len(before) else changes)["shard"].iloc[0])
    held = CuckooFilter.read(bytes(before["buckets"].iloc[0])) if len(before) else CuckooFilter.sized(len(changes))
    for k in changes.loc[~changes["now"], "key"]:
        held.delete(bytes(k))
    fits = all(held.insert(bytes(k)) for k in changes.loc[changes["now"], "key"])
    return pd.DataFrame({"shard": [shard], "buckets": [held.stored() if fits else None]})


@dataclass(frozen=True)
class LineIndex:
    holders: DataFrame
    frequent: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    layers: int = 0

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        holders = written(_holders(docs, id_col, text_col, min_chars), "holders")
        frequent = written(cls._counted(holders).where(F.col("n_docs") >= min_docs), "frequent")
        shards = max(1, -(-frequent.count() // shard_keys))
        return cls(holders, frequent, cls._filters(frequent, shards), shards, min_chars, min_docs)

    @staticmethod
    def _counted(holders: DataFrame) -> DataFrame:
        return holders.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))

    @staticmethod
    def _sharded(keys: DataFrame, shards: int) -> DataFrame:
        @F.arrow_udf("int")
        def shard(key: pa.Array) -> pa.Array:
            return pa.array(shard_of(np.frombuffer(b"".join(k.as_py() for k in key), U).reshape(-1, 2), shards), pa.int32())

        return keys.withColumn("shard", shard("key"))

    @classmethod
    def _filters(cls, frequent: DataFrame, shards: int) -> DataFrame:
        by_shard = cls._sharded(frequent.select("key"), shards)
        return written(by_shard.groupBy("shard").applyInPandas(_built(shards), "shard int, buckets binary"), "filters")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With docs added; references that are there already change nothing."""
        new = written(_holders(docs, id_col, text_col, self.min_chars).join(self.holders, ["doc_id", "key"], "left_anti"), "inserted")
        return self._changed(self.holders.unionByName(new), new)

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents of doc_ids; ids that are not there change nothing."""
        ids = doc_ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        gone = written(self.holders.join(ids, "doc_id", "left_semi"), "deleted")
        gone_ids = written(gone.select("doc_id").distinct(), "tombstones")
        return self._changed(self.holders.join(gone_ids, "doc_id", "left_anti"), gone)

    def _changed(self, holders: DataFrame, references: DataFrame) -> LineIndex:
        """holders: the tables before, with one more of new references or of deleted ids; from LAYERS on, written as one."""
        layers = self.layers + 1
        if layers >= LAYERS:
            holders, layers = written(holders, "holders"), 0
        keys = written(references.select("key").distinct(), "changed_keys")
        counted = written(self._counted(holders.join(keys, "key", "left_semi")).where(F.col("n_docs") >= self.min_docs), "changed")
        # Of the frequent keys and the filters, too, only what changes is written.
        frequent = self.frequent.join(keys, "key", "left_anti").unionByName(counted)
        frequent = frequent if layers else written(frequent, "frequent")
        up = counted.join(self.frequent, "key", "left_anti").select("key", F.lit(True).alias("now"))
        down = self.frequent.join(keys, "key", "left_semi").join(counted, "key", "left_anti").select("key", F.lit(False).alias("now"))
        changes = written(self._sharded(up.unionByName(down), self.shards), "changes")
        touched = changes.select("shard").distinct()
        new = self.filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_updated, "shard int, buckets binary")
        new = written(new, "filters")
        filters = self.filters.join(touched, "shard", "left_anti").unionByName(new)
        filters = filters if layers else written(filters, "filters")
        out = replace(self, holders=holders, frequent=frequent, filters=filters, layers=layers)
        if new.where("buckets IS NULL").limit(1).count():
            shards = 2 * self.shards
            out = replace(out, shards=shards, filters=self._filters(frequent, shards))
        return out

    def probe(self, map_side_keys: int) -> Probe | None:
        """What can be sent to the executors, both sizes checked."""
        if self.filters.agg(F.coalesce(F.sum(F.length("buckets")), F.lit(0))).first()[0] > FILTER_BYTES:
            return None
        filters = {r.shard: bytes(r.buckets) for r in self.filters.collect()}
        if self.frequent.count() > map_side_keys:
            return Probe(filters, self.shards, None, None)
        table = self.frequent.select("key", "max_doc").toPandas()
        return Probe(filters, self.shards, table["key"].to_numpy(object), table["max_doc"].to_numpy(np.int64))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str = "kept_text", map_side_keys: int = MAP_SIDE_KEYS) -> DataFrame:
        """docs with n_lines, n_dropped and the kept text."""
        probe = self.probe(map_side_keys)
        sent = docs.sparkSession.sparkContext.broadcast(probe) if probe else None
        min_chars = self.min_chars
        made = fresh([*docs.columns, "n_lines", "n_dropped", to], "cleaned")
        id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
        kind = "n_lines long, n_dropped long, kept string"
        if probe and probe.keys is not None:

            @F.arrow_udf(kind)
            def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                own = sent.value.opened()
                for ids, texts in batches:
                    rows = [(t.as_py() or "").split("\n") for t in texts]
                    keys = [[line_key(x, min_chars) for x in lines] for lines in rows]
                    flat = [k for ks in keys for k in ks if k]
                    seen = {k for k, maybe in zip(flat, own.maybe(flat), strict=True) if maybe} if flat else set()
                    held = {k: own.exact[k] for k in seen if k in own.exact}
                    yield _cleaned([[x for x, k in zip(lines, ks, strict=True) if k not in held or i is None or held[k] == i] for i, lines, ks in zip(ids.to_pylist(), rows, keys, strict=True)], rows)
                trim()

            out = docs.withColumn(made, clean(id_, text))
        else:
            maybe = self._maybe(docs, id_, text, sent)
            hit = maybe.join(self.frequent, "key").where(F.col("doc_id") != F.col("max_doc"))
            drop, joined = fresh([*docs.columns, made], "drop_keys"), fresh([*docs.columns, made], "drop_doc")
            drops = hit.groupBy(F.col("doc_id").alias(joined)).agg(F.collect_set("key").alias(drop))

            @F.arrow_udf(kind)
            def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                for texts, gone in batches:
                    rows = [(t.as_py() or "").split("\n") for t in texts]
                    kept = [lines if not g else [x for x in lines if line_key(x, min_chars) not in g] for lines, g in zip(rows, (set(g.as_py() or ()) for g in gone), strict=True)]
                    yield _cleaned(kept, rows)

            out = docs.join(drops, id_ == F.col(joined), "left").withColumn(made, clean(text, F.col(drop))).drop(drop, joined)
        return out.withColumns({"n_lines": F.col(made)["n_lines"], "n_dropped": F.col(made)["n_dropped"], to: F.col(made)["kept"]}).drop(made)

    def _maybe(self, docs: DataFrame, id_, text, sent) -> DataFrame:
        """(doc_id, key) of the lines of docs that pass the filters; of all lines, where those are too large to be sent."""
        min_chars = self.min_chars

        @F.arrow_udf("array<binary>")
        def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = sent.value.opened() if sent is not None else None
            for texts in batches:
                rows = [list({k for k in keys_of(t.as_py(), min_chars) if k}) for t in texts]
                flat = [k for ks in rows for k in ks]
                yes = iter((own.maybe(flat).tolist() if own is not None else [True] * len(flat)) if flat else [])
                yield pa.array([[k for k in ks if next(yes)] for ks in rows], pa.list_(pa.binary()))

        return docs.where(id_.isNotNull()).select(id_.alias("doc_id"), F.explode(keys(text)).alias("key")).distinct()


def _cleaned(kept: list[list[str]], rows: list[list[str]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array([len(x) for x in rows], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(rows, kept, strict=True)], pa.int64()), pa.array(["\n".join(x) for x in kept], pa.string())], ["n_lines", "n_dropped", "kept"]
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = LineIndex.build(docs).apply(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    space = r"\x20\x09-\x0D"
    return rf"""
    WITH l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
    k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[{space}]+', ''), '[{space}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    m AS (SELECT k.doc_id, i, line, max_doc IS NOT NULL AND max_doc <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
    """
