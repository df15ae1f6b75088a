"""Repair of conversation structure: the cheapest edits that make a conversation alternate between user and assistant.

1. Turns are put in order by (turn, role, md5 of the text), nulls first, and their faults found: blank, repeated, or cut
   off before the end of a sentence.
2. A dynamic program over the retained turns (kept or given another role): what lies between two retained turns is
   deleted, so a retained sequence costs its own edits, the difference of two prefix sums of deletions for each gap, and
   the insertions that its pairs of roles need. For each role that a retained sequence may end in, the running minimum of
   (cost less deletions so far) prices every gap at once. Its differences are few, so steps are remembered, and a turn is
   one look-up. Of equal costs the least audit wins; as audits of the same turns are never prefixes of each other, the
   order of the audits of the last retained roles decides, without comparing strings.
3. The audit (K keep, R other role, D delete, I insert) is replayed over the turns in order, which gives the repaired ones.

Both passes stream over turns sorted within partitions. The first holds 16 bytes and a reference for each turn of one
conversation, the second nothing, so texts may be long and conversations too; their result is one audit, a letter an edit.

Null roles and texts are one blank, null turns come first, a null conversation id is a conversation like any other.
Repeated rows are turns of their own, the later one being a duplicate. Conversations without turns have no rows in the
operator's results. An empty table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._shared import ASCII_SPACE, read, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What a retained sequence may end in: nothing, or a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Insertions between two retained turns, by their roles, and after the last one.
BETWEEN = {(START, SYSTEM): 0, **{(r, USER): int(r == USER) for r in range(4)}, **{(r, ASSISTANT): int(r != USER) for r in range(4)}}
AFTER = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}
FREE = float("inf")
WIDE = 2 * INSERT + DELETE

Prices = tuple[float, ...]


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, digest) without nulls in role and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    return turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"))


@functools.cache
def step(prices: Prices, order: tuple[int, ...], initial: str, must_go: bool, cut: bool) -> tuple[Prices, tuple[int, ...], float, tuple]:
    """Running minima and the order of their audits after a turn; what was taken off all minima; (origin, letters) by role.

    A minimum that is WIDE above the least is dropped: the least one's role serves as any other with two insertions, and
    deleting a turn costs less than keeping it there. So there are few arguments.
    """
    found = {r: (p, order[r], "D", r) for r, p in enumerate(prices) if p < FREE}
    if not must_go:
        extra = TRUNCATED * cut - DELETE  # a gap's price holds this turn's deletion, as all before it
        letters = [(ENDS[initial], "K", KEEP)] if initial in ENDS else []
        letters += [(r, "R", REROLE) for r in (USER, ASSISTANT) if ENDS.get(initial) != r]
        for role, letter, price in letters:
            for origin, p in enumerate(prices):
                if p < FREE and (origin, role) in BETWEEN:
                    n = BETWEEN[origin, role]
                    one = (p + INSERT * n + price + extra, order[origin], "I" * n + letter, origin)
                    if role not in found or one < found[role]:
                        found[role] = one
    least = min(x[0] for x in found.values())
    found = {r: x for r, x in found.items() if x[0] <= least + WIDE}
    place = {r: i for i, r in enumerate(sorted(found, key=lambda r: found[r][1:3]))}
    back = tuple((found[r][3], found[r][2]) if r in found else None for r in range(4))
    return tuple(found[r][0] - least if r in found else FREE for r in range(4)), tuple(place.get(r, -1) for r in range(4)), least, back


class Repair:
    """The program over one conversation's turns, given one by one."""

    def __init__(self) -> None:
        self.prices, self.order, self.base = (0.0, FREE, FREE, FREE), (0, -1, -1, -1), 0.0
        self.back: list[tuple] = []
        self.seen: set[tuple[str, str]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def add(self, role: str, digest: str, blank: bool, truncated: bool) -> None:
        again = (role, digest) in self.seen
        self.seen.add((role, digest))
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        self.blank += blank
        self.duplicate += again and not blank
        cut = truncated and not blank and not again
        self.truncated += cut
        initial = role[:1] if role[:1] in ENDS else ""
        self.prices, self.order, moved, back = step(self.prices, self.order, initial, blank or again, cut)
        self.base += moved
        self.back.append(back)

    def result(self) -> tuple[int, str]:
        """The cost and the audit."""
        total, _, tail, role = min((p + INSERT * AFTER[r], self.order[r], "I" * AFTER[r], r) for r, p in enumerate(self.prices) if p < FREE)
        parts = [tail]
        for back in reversed(self.back):
            role, letters = back[role]
            parts.append(letters)
        return int(total + self.base + DELETE * len(self.back)), "".join(reversed(parts))


REPORT = "turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def reports(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, blank, duplicate, truncated, illegal, cost, audit) of each conversation; turns as ordered() gives them."""
    conv = turns.schema["conv_id"].dataType
    blank = ~F.col("text").rlike(f"[^{ASCII_SPACE}]")
    cut = ~F.col("text").rlike(f"[.!?][{ASCII_SPACE}]*\\z")
    facts = turns.select("conv_id", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, rows = None, None, []
        for batch in batches:
            for c, role, digest, b, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if now is None or c != key:
                    if now is not None:
                        rows.append(_told(key, now))
                    now, key = Repair(), c
                now.add(role, digest, b, t)
            if len(rows) >= 10_000:
                yield _batch(rows, batch.schema.field(0).type)
                rows = []
        if now is not None:
            rows.append(_told(key, now))
            yield _batch(rows, batch.schema.field(0).type)

    dealt = facts.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest")
    return dealt.mapInArrow(run, f"conv_id {conv.simpleString()}, {REPORT}")


def _told(key: object, now: Repair) -> tuple:
    cost, audit = now.result()
    return key, len(now.back), now.blank, now.duplicate, now.truncated, now.illegal, cost, audit


def _batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [conv, *[pa.int64()] * 6, pa.string()], strict=True)], ["conv_id", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def repaired(turns: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations, in order within partitions; told: their reports.

    Rows of a conversation lie together in one partition, places count from 0. Inserted turns have an empty text.
    """
    conv = turns.schema["conv_id"].dataType
    nothing = lambda kind: F.lit(None).cast(kind)
    first = told.select("conv_id", F.lit(0).alias("kind"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("digest"), F.col("audit").alias("text"))
    both = first.unionByName(turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text"))
    dealt = both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, end, key = "", 0, 0, START, None
        out: list[tuple] = []

        def inserted() -> None:
            nonlocal at, place, end
            while at < len(audit) and audit[at] == "I":
                at, end = at + 1, ASSISTANT if end == USER else USER
                out.append((key, place, "I", "user" if end == USER else "assistant", ""))
                place += 1

        for batch in batches:
            for c, kind, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 5)), strict=True):
                if kind == 0:
                    inserted()
                    audit, at, place, end, key = text, 0, 0, START, c
                    continue
                if audit[at] != "D":
                    inserted()
                letter = audit[at]
                at += 1
                if letter != "D":
                    if letter == "R":
                        role = "assistant" if end == USER else "user"
                    end = ENDS[role[:1]]
                    out.append((key, place, letter, role, text))
                    place += 1
            if out:
                yield _lines(out, batch.schema.field(0).type)
                out = []
        inserted()
        if out:
            yield _lines(out, batch.schema.field(0).type)

    return dealt.mapInArrow(run, f"conv_id {conv.simpleString()}, place long, edit string, role string, text string")


def _lines(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [conv, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], ["conv_id", "place", "edit", "role", "text"])


def line_hashes(fixed: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each repaired conversation's lines `role:text`; fixed as repaired() gives it."""
    conv = fixed.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, rows = None, None, []
        for batch in batches:
            for c, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if place == 0:
                    if now is not None:
                        rows.append((key, now.hexdigest()))
                    key, now = c, hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
        if now is not None:
            rows.append((key, now.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows])], ["conv_id", "sha256"])

    return fixed.mapInArrow(run, f"conv_id {conv.simpleString()}, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of ordered() with the damage of the test: by crc32 of `conv_id:turn` modulo 20 dropped, emptied and so on."""
    kind: Column = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    hurt = turns.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return ordered(out.drop("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ordered(read(spark, sf_dir, "conversations"))
    turns = damaged(given)
    told = written(reports(turns), "reports")
    hashes = line_hashes(repaired(turns, told))
    whole = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("n")
    gaps = turns.groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("n")).select("conv_id", F.coalesce(whole.try_cast("long"), F.lit(0)).alias("gaps"))
    parts = [given.select("conv_id"), gaps, told.drop("turns"), hashes]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )


def oracle() -> str:
    """Every edit of every turn as a state machine, the cheapest path to each state kept: another way to the same audits."""
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::UBIGINT)), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT)"
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    moves = "('E','E','',0),('S','S','',0),('U','U','',0),('A','A','',0),('E','U','I',3),('S','U','I',3),('A','U','I',3),('U','A','I',3),('E','A','II',6),('S','A','II',6),('A','A','II',6),('U','U','II',6)"
    return rf"""
    WITH RECURSIVE crc AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda z: z::UBIGINT)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    h AS (SELECT *, {crc} % 20 AS kind FROM k, (SELECT list(v ORDER BY i) AS tab FROM crc)),
    g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS x FROM g),
    f AS (SELECT *, CASE WHEN {blank} THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
    m(s, t, ins, price) AS (VALUES {moves}),
    e(letter, x, t, role, price) AS (VALUES ('K','s','S',NULL,0),('K','u','U',NULL,0),('K','a','A',NULL,0),('R',NULL,'U','user',3),('R',NULL,'A','assistant',3),('D',NULL,NULL,NULL,4)),
    legal(s, t) AS (VALUES ('E','S'),('E','U'),('S','U'),('A','U'),('U','A')),
    d AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 'E' AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM f
      UNION ALL
      (SELECT conv_id, i, t, cost, audit, said FROM (
         SELECT f.conv_id, f.i, coalesce(e.t, m.t) AS t, d.cost + m.price + e.price + CASE WHEN f.fault = 't' AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost, d.audit || m.ins || e.letter AS audit,
           d.said || CASE WHEN m.ins = '' THEN CAST([] AS VARCHAR[]) WHEN m.ins = 'I' AND m.t = 'U' THEN ['user:'] WHEN m.ins = 'I' THEN ['assistant:'] WHEN m.t = 'A' THEN ['user:', 'assistant:'] ELSE ['assistant:', 'user:'] END
                  || CASE WHEN e.letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(e.role, f.role) || ':' || f.text] END AS said
         FROM d JOIN m ON m.s = d.s JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN e ON (e.letter <> 'K' OR e.x = f.x) AND (e.letter = 'D' OR f.fault IN ('', 't'))
         WHERE e.letter = 'D' OR EXISTS (SELECT 1 FROM legal WHERE legal.s = m.t AND legal.t = e.t))
       QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1)),
    n AS (SELECT conv_id, max(i) AS n, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
    y AS (SELECT d.conv_id, d.cost + CASE d.s WHEN 'U' THEN 3 WHEN 'S' THEN 6 ELSE 0 END AS cost, d.audit || CASE d.s WHEN 'U' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END AS audit,
            d.said || CASE d.s WHEN 'U' THEN ['assistant:'] WHEN 'S' THEN ['user:', 'assistant:'] ELSE CAST([] AS VARCHAR[]) END AS said
          FROM d JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.n = d.i),
    z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
    """
