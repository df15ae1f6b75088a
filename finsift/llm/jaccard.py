"""N-gram Jaccard join: exact links between documents whose shingle sets are similar, found by a grouped prefix join.

A document's set holds the hashes of its distinct 5-word shingles (fewer words: the whole sequence as one; no words:
empty, linked with nothing). Two documents link when inter / union >= percent / 100. The steps:

1. Shingles in many documents are counted approximately. They come last in the global order of shingles, all others
   in the order of their hashes. The order needs only to be the same everywhere, so the counts may be rough.
2. Similar sets share an element of their prefixes (the first n - ceil(t * n) + 1 elements). Documents of equal sets
   are one class, classes of equal prefix and size one group, and each group's prefix enters the join once.
3. Classes are laid in an order that brings near copies together and cut into blocks of bounded size. The prefix join
   runs between groups and blocks: a group reaches a block that holds one of its prefix elements if sizes, places and
   the number of shared elements allow any similar class there. So a cluster of m near copies gives m rows for each
   block that it fills, not a row for each of its pairs.
4. The groups that reach each other's blocks are expanded into their classes, and every two classes that meet in a tile
   (a pair of blocks) are verified by their whole sets, as one product of matrices. A tile gives one row for each class
   with links: the number of them, and the smallest class that they connect it with. No link is left out, none is
   counted twice, as two classes meet in one tile only.

`similar_components` sums those rows; `similar_pairs` has the same tiles list each link.

A row without an id has no component and no links. Rows are told apart by their texts: each row has the component of
its own text, the smallest id of any row with a text that links reach. Rows that repeat id and text count once as
links. Null texts count as empty. Names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finsift.llm._bytes import SPACE, U, blocks, mix, raw, shingle_hashes, trim, word_hashes
from finsift.llm._shared import read, release, small_batches, written, written_at
from finsift.llm.components import connected

WORDS, PERCENT = 5, 75
#: The most frequent shingles that are put last in the order; 16 bytes each are sent to the executors.
COMMON = 1 << 18
#: Least and most bits of the map that keeps texts out of the verification; 8 MB at most. Beyond, the join does the rest.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Shingles and classes in a block, about.
BLOCK_SHINGLES, BLOCK_CLASSES = 1 << 20, 1 << 10
UNIT = BLOCK_SHINGLES // BLOCK_CLASSES
#: The smallest hashes of a set, of which the most frequent one gives its place in the order of classes.
NEAR = 8
#: Shingles that so many classes of a tile hold are counted by a product of matrices, others pair by pair.
DENSE = 24
#: A shingle is counted where a run of about so many shingles holds it in several documents.
RUN = 1 << 22
RUN_DOCS = 3


def document_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts, the sorted distinct hashes of each text, and offsets."""
    data, at = raw(texts)
    for i, j in blocks(at):
        low, high = at[i], at[j]
        words, _, bounds = word_hashes(data[low:high], at[i : j + 1] - low, ~SPACE)
        hashes, off = shingle_hashes(words, bounds, k)
        row = np.repeat(np.arange(j - i), np.diff(off))
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[new], row[new]
        yield hashes, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])


def digest(values: np.ndarray, off: np.ndarray, salt: int) -> np.ndarray:
    """Of each slice, without regard to order."""
    total = np.concatenate([[U(0)], np.cumsum(mix(values + U(salt)), dtype=U)])
    return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(U) * U(salt | 1)).view(np.int64)


def common_shingles(docs: DataFrame, text_col: str, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and rough document counts of the shingles that stand out in some run of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(RUN, U), 0

        def told():
            run = held[:size]
            run.sort()
            often = np.unique(run[RUN_DOCS - 1 :][run[RUN_DOCS - 1 :] == run[: 1 - RUN_DOCS]])
            n = np.searchsorted(run, often, "right") - np.searchsorted(run, often)
            return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for hashes, _ in document_sets(batch.column(0), k):
                for part in np.split(hashes, range(RUN, len(hashes), RUN)):
                    if size + len(part) > RUN:
                        yield told()
                        size = 0
                    held[size : size + len(part)] = part
                    size += len(part)
        yield told()
        trim()

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):  # whole texts go to the tasks
        top = found.orderBy(F.desc("n"), "h").limit(most).toPandas()
    h = top["h"].to_numpy(np.int64).view(U)
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def described(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, doc_id, n, digest of the set, digest of prefix and size, place among the classes, prefix in order).

    The first `rare` elements of the prefix are not among the common ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON entries
    names = ["n", "set_a", "set_b", "group_a", "near", "low", "rare"]
    kind = pa.struct([*((c, pa.int64()) for c in names), ("prefix", pa.list_(pa.int64()))])

    @F.arrow_udf(", ".join(f"{c} long" for c in names) + ", prefix array<long>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        often, count = sent.value
        for texts in batches:
            parts = []
            for hashes, off in document_sets(texts, k):
                n = np.diff(off)
                row = np.repeat(np.arange(len(n)), n)
                seen = np.zeros(len(hashes), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                    seen = np.where(often[at] == hashes, count[at], 0)
                within = np.arange(len(hashes)) - np.repeat(off[:-1], n)
                near, low = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                low[n > 0] = hashes[off[:-1][n > 0]].view(np.int64)
                few = np.flatnonzero(within < NEAR)
                few = few[np.lexsort((hashes[few], -seen[few], row[few]))]
                top = few[np.diff(row[few], prepend=-1) > 0]
                near[row[top]] = hashes[top].view(np.int64)
                order = np.lexsort((hashes, seen, row))
                length = np.where(n > 0, prefix_length(n, percent), 0)
                prefix = hashes[order][within < np.repeat(length, n)]
                p_off = np.concatenate([[0], np.cumsum(length)])
                group = mix(digest(prefix, p_off, 0x4B).view(U) + n.astype(U)).view(np.int64)
                rare = np.minimum(np.bincount(row[seen == 0], minlength=len(n)), length)
                told = [n, digest(hashes, off, 0x1D), digest(hashes, off, 0x2F35), group, near, low, rare]
                lists = pa.ListArray.from_arrays(pa.array(p_off, pa.int32()), pa.array(prefix.view(np.int64)))
                parts.append(pa.StructArray.from_arrays([*map(pa.array, told), lists], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        trim()

    told = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), describe(F.col(f"`{text_col}`")).alias("d"))
    return told.select(F.monotonically_increasing_id().alias("row"), "doc_id", "d.*")


def laid(classes: DataFrame) -> DataFrame:
    """classes with a number c of their own and their block, in an order that brings near copies together."""
    order = ["near", "low", "group_a", "set_a", "set_b"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = len(batch)
            weight = np.maximum(batch.column("n").to_numpy(), UNIT)
            end = run + np.cumsum(weight)
            more = [pa.array(np.full(size, part, np.int64)), pa.array(end - weight), pa.array(end)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "begin", "end"])
            run = int(end[-1]) if size else run

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = classes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    cells = written(ranged.mapInArrow(numbered, f"{fields}, part long, begin long, end long"), "cells")
    # One row for each partition: where it begins among all.
    ends = cells.groupBy("part").agg(F.max("end").alias("end")).orderBy("part").collect()
    starts, run = [], 0
    for r in ends:
        starts.append((r["part"], run))
        run += r["end"]
    at = classes.sparkSession.createDataFrame(starts, "part long, start long")
    # A class weighs at least the unit, so that its place in units is a number of its own.
    c = F.expr(f"(start + begin) div {UNIT}")
    placed = cells.join(F.broadcast(at), "part").select(c.alias("c"), "group_a", "n", "name", "size", "set_a", "set_b", "row")
    return placed.withColumn("block", F.expr(f"c div {BLOCK_CLASSES}"))


def whole_sets(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(name, set_a, set_b, set) of the documents whose ids asked names, and few others: all hashes in order.

    A map of hashed ids, of bounded size whatever their number, keeps most other texts out before any shuffle.
    """
    number = asked.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * number):
        bits *= 2
    slot = F.xxhash64("name").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    filled = asked.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))
            done = 0
            for h, off in document_sets(batch.column(2), k):
                n = len(off) - 1
                own = pa.array([h[off[i] : off[i + 1]].tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array(digest(h, off, 0x1D)), pa.array(digest(h, off, 0x2F35)), own], ["name", "set_a", "set_b", "set"])
                done += n
        trim()

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("name"), F.col(f"`{text_col}`").alias("t")).where("name IS NOT NULL")
    return named.select("name", slot.alias("slot"), "t").mapInArrow(sets, "name long, set_a long, set_b long, set binary")


def shared_counts(one: list[np.ndarray], two: list[np.ndarray] | None) -> np.ndarray:
    """Intersection sizes of each set of one with each of two (None: of one; only a < b is filled)."""
    own = [*one, *(two or [])]
    wide = len(one) if two is None else len(two)
    out = np.zeros(len(one) * wide, np.int32)
    if not own:
        return out.reshape(len(one), wide)
    size = np.array([len(x) for x in own])
    token = np.concatenate(own)
    order = np.argsort(token, kind="stable")  # within a shingle, sets in their order: those of one first
    token, member = token[order], np.repeat(np.arange(len(own)), size)[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(token)))
    run = np.repeat(np.arange(len(begin)), length)
    light = np.flatnonzero((length[run] > 1) & (length[run] <= DENSE))
    run_l, member_l = run[light], member[light]
    shift = 0 if two is None else len(one)
    for d in range(1, DENSE):
        met = np.flatnonzero(run_l[d:] == run_l[:-d])
        if not len(met):
            break
        a, b = member_l[met], member_l[met + d]
        if two is not None:
            across = (a < shift) & (b >= shift)
            a, b = a[across], b[across]
        np.add.at(out, a * wide + b - shift, 1)
    out = out.reshape(len(one), wide)
    heavy = np.flatnonzero(length > DENSE)
    for i in range(0, len(heavy), 2048):
        some = heavy[i : i + 2048]
        at = np.zeros(len(begin), np.int64)
        at[some] = 1 + np.arange(len(some))
        here = np.flatnonzero(at[run])
        held = np.zeros((len(some), len(own)), np.float32)
        held[at[run[here]] - 1, member[here]] = 1
        out += (held[:, : len(one)].T @ held[:, shift:]).astype(np.int32)
    return out


def linked(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the similar pairs, b counted from the first of two (None: a < b within one)."""
    inter = shared_counts(one, two).astype(np.int64)
    n1 = np.array([len(x) for x in one])
    n2 = n1 if two is None else np.array([len(x) for x in two])
    good = (inter > 0) & (100 * inter >= percent * (n1[:, None] + n2[None, :] - inter))
    return np.nonzero(np.triu(good, 1) if two is None else good)


def joined_up(number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of a number of nodes, the smallest that the pairs connect it with."""
    to = np.arange(number)
    while True:
        least = np.minimum(to[a], to[b])
        new = to.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == to).all():
            return to
        to = new


def verified(tiles: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Of rows (lo, hi, side, c, size, set), by tile: (a, b) of each link, or (c, root, others) of each class with links."""

    def told(one: dict, two: dict, same: bool) -> pa.RecordBatch:
        c = np.array([*one, *two], np.int64)
        size = np.array([x[0] for x in (*one.values(), *two.values())], np.int64)
        a, b = linked([x[1] for x in one.values()], None if same else [x[1] for x in two.values()], percent)
        b = b if same else b + len(one)
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(c[a], c[b])), pa.array(np.maximum(c[a], c[b]))], ["a", "b"])
        others = np.zeros(len(c), np.int64)
        np.add.at(others, a, size[b])
        np.add.at(others, b, size[a])
        root = joined_up(len(c), a, b)
        has = np.flatnonzero(others)
        return pa.RecordBatch.from_arrays([pa.array(c[has]), pa.array(c[root[has]]), pa.array(others[has])], ["c", "root", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ({}, {})
        for batch in batches:
            for lo, hi, side, c, size, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (lo, hi) != now:
                    if now:
                        yield told(*sides, now[0] == now[1])
                    now, sides = (lo, hi), ({}, {})
                sides[side][c] = (size, np.frombuffer(own, U))
        if now:
            yield told(*sides, now[0] == now[1])
        trim()

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.select("lo", "hi", "side", "c", "size", "set").repartition(parts, "lo", "hi").sortWithinPartitions("lo", "hi")
    return dealt.mapInArrow(run, "a long, b long" if pairs else "c long, root long, others long")


def similar_tiles(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, common: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `verified` finds, the classes (c, block, group_a, n, name, size, set_a, set_b, row), and (doc_id, n, set_a, set_b) of each row."""
    spark = docs.sparkSession
    seen = common_shingles(docs, text_col, k, common)
    rows, rows_at = written_at(described(docs, id_col, text_col, k, percent, seen), "described")

    # Classes of equal sets, named by their smallest id.
    has = rows.where("n > 0 AND doc_id IS NOT NULL")
    keys = ["set_a", "set_b", "n", "group_a", "near", "low"]
    classes = has.groupBy(*keys).agg(F.min("doc_id").alias("name"), F.min("row").alias("row"), F.countDistinct("doc_id").alias("size"))
    cells = laid(classes)

    # A cell is what a block has of a group. Each group's prefix enters once for each of its cells; elements that no
    # other class holds link nothing. Common elements need no count for that, so no key is hot here.
    groups = cells.groupBy("group_a", "block").agg(F.min("c").alias("cell"), (F.count("*") > 1).cast("long").alias("many"))
    first = cells.groupBy("group_a").agg(F.min("row").alias("row"))
    reps = rows.select("row", "n", "rare", "prefix").join(groups.join(first, "group_a").select("row", "cell", "many").hint("shuffle_hash"), "row")
    place = F.expr("shiftleft(n, 32) + shiftleft(CAST(pos AS LONG), 1) + many AS place")
    rare = reps.select("cell", "n", "many", F.posexplode(F.expr("slice(prefix, 1, CAST(rare AS INT))")).alias("pos", "token")).select("token", "cell", place)
    rare = rare.withColumn("all", F.count("*").over(W.partitionBy("token"))).where("all > 1 OR place % 2 = 1").drop("all")
    often = reps.select("cell", "n", "many", "rare", F.posexplode(F.expr("slice(prefix, CAST(rare AS INT) + 1, size(prefix))")).alias("pos", "token"))
    often = often.withColumn("pos", F.col("pos") + F.col("rare")).select("token", "cell", place)
    lists, lists_at = written_at(rare.unionByName(often), "lists")
    rows = written(rows.select("doc_id", "n", "set_a", "set_b"), "sizes")
    release(spark, rows_at)

    entry = lists.selectExpr("token", "cell", f"cell div {BLOCK_CLASSES} AS block", "shiftright(place, 32) AS n", "shiftright(place % 4294967296, 1) AS pos", "place % 2 AS many")
    there = entry.groupBy("token", "block").agg(*(F.expr(x) for x in ("sum(1 + many) AS held", "min(n) AS n0", "max(n) AS n1", "max(pos) AS p1", "max(n - pos) AS r1")))
    x, y = entry.alias("x"), there.alias("y")
    # The largest overlap of two sets that share an element at these places of the order, and what percent takes of it.
    room = "least(x.pos, y.p1) + least(x.n - x.pos, y.r1)"
    fits = f"(x.block <> y.block OR y.held > 1) AND 100 * x.n >= {percent} * y.n0 AND 100 * y.n1 >= {percent} * x.n AND {100 + percent} * ({room}) >= {percent} * (x.n + greatest(y.n0, ({percent} * x.n + 99) div 100))"
    met = x.join(y, F.expr(f"x.token = y.token AND {fits}")).selectExpr("x.cell", "y.block AS other", "x.n", "y.n0", "y.n1")
    counted = met.groupBy("cell", "other", "n").agg(F.count("*").alias("shared"), F.min("n0").alias("n0"), F.max("n1").alias("n1"))
    # Of two prefixes, take the one that ends first in the order. Shared elements up to its end are in both prefixes, so
    # they were counted; the others are among the elements after it, which are ceil(percent * n / 100) - 1.
    after = f"({percent} * least(greatest(n, n1), 100 * n div {percent}) + 99) div 100 - 1"
    reached = counted.where(f"{100 + percent} * (shared + {after}) >= {percent} * (n + greatest(n0, ({percent} * n + 99) div 100))")
    own = cells.join(groups.drop("many"), ["group_a", "block"]).select("c", "name", "set_a", "set_b", "size", "cell", F.col("block").alias("own"))
    sides = reached.join(own, "cell").select("c", "name", "set_a", "set_b", "size", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    asked, asked_at = written_at(sides.distinct(), "asked")
    release(spark, lists_at)
    sets = whole_sets(docs, asked.select("name").distinct(), id_col, text_col, k)
    found = written(verified(asked.join(sets, ["name", "set_a", "set_b"]), percent, pairs), "verified")
    release(spark, asked_at)
    return found, cells, rows


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, common: int = COMMON) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every link, as (links, classes, rows).

    links: (a, b), a < b, all pairs of similar classes. classes: (set_a, set_b, n, class), class being the smallest id
    of the documents with that set. rows: (doc_id, n, set_a, set_b) of each row of docs, which gives the members.
    """
    found, cells, rows = similar_tiles(docs, id_col, text_col, k, percent, common, True)
    one, two = (cells.select(F.col("c").alias(x), F.col("name").alias(f"name_{x}")) for x in "ab")
    links = found.join(one, "a").join(two, "b").select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"))
    return links, cells.select("set_a", "set_b", "n", F.col("name").alias("class")), rows


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs.

    n_links is the number of other ids with a similar text, copies included; 0 for rows without an id.
    """
    found, cells, rows = similar_tiles(docs, id_col, text_col, k, percent, common, False)
    parts = connected(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    others = found.groupBy("c").agg(F.sum("others").alias("others"))
    sets = ["set_a", "set_b"]
    linked_up = cells.join(parts, cells["c"] == parts["node"]).join(others, "c").select(*sets, "name", "size", "component", "others")
    named = linked_up.groupBy("component").agg(F.min("name").alias("component_id"))
    many = linked_up.join(named, "component").select(*sets, "component_id", (F.col("size") - 1 + F.col("others")).alias("n_links"))
    alone = cells.where("size > 1").join(parts, cells["c"] == parts["node"], "left_anti").select(*sets, F.col("name").alias("component_id"), (F.col("size") - 1).alias("n_links"))
    # Only the classes with links or copies: all other rows are their own component.
    keyed = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_a")).alias("set_a"), "set_b")
    out = keyed.join(many.unionByName(alone), sets, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_links")


def oracle() -> str:
    space = r"\x20\x09-\x0D"
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{space}]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n u ON a = u.doc_id JOIN n v ON b = v.doc_id WHERE 100 * i >= {PERCENT} * (u.n + v.n - i)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    c AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON c.a = e.a WHERE c.r < e.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r) FROM c WHERE c.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
    """
