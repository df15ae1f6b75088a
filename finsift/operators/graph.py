"""Entities, relations and the property graph as two tables, vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finsift.functions import lexicon as L
from finsift.functions.numeric import _let
from finsift.functions.text import each_item, match_places, sentences

#: Rule-based relation: two names around one of the classified verbs.
TRIPLE = r"([A-Z][a-z]+) (is|has|owns|manages|controls|reports|created|transferred|hid|concealed) ([A-Z][a-z]+)"


def _first_of_each(found, key):
    """The items of an array, in order, without those whose key an earlier one has: by sorting, no shuffle."""
    keyed = F.sort_array(F.transform(found, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("x"))))
    firsts = _let(keyed, lambda s: F.filter(s, lambda y, j: (j == 0) | (y["key"] != F.get(s, F.greatest(j - 1, F.lit(0)))["key"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])


def entity_array(text, extra=None, low=None):
    """Array of (ent_type, text, start, end), each text (compared without case) of a type at its first place.

    Lexicon terms, money and organisations, in this order; extra: columns of array<struct<ent_type, text, start, end>>
    from a model, e.g. a pandas UDF. low: the text in lower case, as a column that is there already.
    """
    entity = lambda kind, t, at: F.struct(F.lit(kind).alias("ent_type"), t.alias("text"), at.cast("int").alias("start"), (at + F.length(t)).cast("int").alias("end"))
    low = F.lower(text) if low is None else low
    term = lambda kind, t: F.when(low.contains(t), entity(kind, F.lit(t), F.instr(low, t) - 1))
    terms = F.array(*(term("FINANCIAL_TERM", t) for t in sorted(L.FINANCIAL_TERMS)), *(term("FRAUD_INDICATOR", t) for t in sorted(L.FRAUD_TERMS)))
    named = lambda kind, pattern: _let(L.hits(text, pattern), lambda hits: F.zip_with(hits, match_places(text, hits), lambda x, at: entity(kind, x, at)))
    found = F.filter(F.concat(terms, named("MONEY", L.MONEY), named("ORG", L.ORGANISATION), *(extra or [])), lambda x: x.isNotNull())
    return _first_of_each(found, lambda x: F.struct(x["ent_type"], F.lower(x["text"])))


def named(text) -> list:
    """Columns of places, persons and dates by rules, for entities(extra=...), where no model gives better ones."""
    entity = lambda kind, x, at: F.struct(F.lit(kind).alias("ent_type"), x.alias("text"), at.cast("int").alias("start"), (at + F.length(x)).cast("int").alias("end"))
    found = lambda kind, pattern: _let(L.hits(text, pattern), lambda hits: F.zip_with(hits, match_places(text, hits), lambda x, at: entity(kind, x, at)))
    return [found("GPE", L.PLACE), found("PERSON", L.PERSON), found("DATE", L.NAMED_DATE)]


def _lowered(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_low", F.lower(text_col))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", extra=None) -> DataFrame:
    """(doc_id, ent_type, text, start, end, ord): the entities of entity_array(), a row each."""
    return each_item(_lowered(docs, text_col), F.col(id_col).alias("doc_id"), entity_array(F.col(text_col), extra, F.col("_low")), "ord", "e").select("doc_id", "e.*", "ord")


def deduplicated(df: DataFrame, keys: list, order: str) -> DataFrame:
    """The first row, by order, of each key."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_rank = 1").drop("_rank")


def entity_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", extra=None) -> DataFrame:
    """(doc_id, ent_type, n) of the types that a document has; counted in the document's own array."""
    found = _lowered(docs, text_col).select(F.col(id_col).alias("doc_id"), F.transform(entity_array(F.col(text_col), extra, F.col("_low")), lambda x: x["ent_type"]).alias("kinds"))
    return found.select("doc_id", "kinds", F.explode(F.array_distinct("kinds")).alias("ent_type")).select("doc_id", "ent_type", F.expr("size(filter(kinds, x -> x = ent_type))").alias("n"))


#: Types in the order in which they are told first.
KEY_TYPES = ("FRAUD_INDICATOR", "FINANCIAL_TERM", "ORG", "MONEY")


def key_entity_array(found, per_type: int = 5, total: int = 10):
    """The first entities of the types that matter, in the order of the types."""
    of = lambda kind: F.slice(F.filter(found, lambda x: x["ent_type"] == kind), 1, per_type)
    return F.slice(F.concat(*map(of, KEY_TYPES)), 1, total)


def key_entities(docs: DataFrame, per_type: int = 5, total: int = 10, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc_id, rank, ent_type, text)."""
    found = _lowered(docs, text_col).select(F.col(id_col).alias("doc_id"), entity_array(F.col(text_col), low=F.col("_low")).alias("found"))
    some = found.select("doc_id", F.posexplode(key_entity_array(F.col("found"), per_type, total)).alias("rank", "e"))
    return some.select("doc_id", (F.col("rank") + 1).alias("rank"), "e.ent_type", "e.text")


def relation_array(text):
    """Array of (subject, predicate, object, relation_type), each triple (compared without case) once: verbs, then concealment."""
    part = lambda s, g: F.regexp_extract_all(s, F.lit(TRIPLE), F.lit(g))
    verbs = F.create_map(*(F.lit(x) for pair in L.VERBS.items() for x in pair))
    relation = lambda s, p, o, kind: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"), kind.alias("relation_type"))
    triples = F.transform(F.arrays_zip(part(text, 1).alias("s"), part(text, 2).alias("p"), part(text, 3).alias("o")), lambda x: relation(x["s"], x["p"], x["o"], F.coalesce(F.try_element_at(verbs, F.lower(x["p"])), F.lit("RELATED_TO"))))
    hidden = F.transform(
        F.filter(sentences(text), lambda s: F.lower(s).rlike("hid|concealed|transferred") & s.rlike(L.ORGANISATION) & s.rlike(L.MONEY)),
        lambda s: relation(F.regexp_extract(s, L.ORGANISATION, 0), F.lit("CONCEALED"), F.regexp_extract(s, L.MONEY, 0), F.lit("FRAUD_ACTION")),
    )
    return _first_of_each(F.concat(triples, hidden), lambda x: F.struct(F.lower(x["subject"]), F.lower(x["predicate"]), F.lower(x["object"])))


def relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc_id, ord, subject, predicate, object, relation_type): the relations of relation_array(), a row each."""
    return each_item(docs, F.col(id_col).alias("doc_id"), relation_array(F.col(text_col)), "ord", "r").select("doc_id", "ord", "r.*")


def vertices(docs: DataFrame, ents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(label, name), each once: documents and entities."""
    own = docs.select(F.lit("Document").alias("label"), F.col(id_col).cast("string").alias("name"))
    found = ents.where("length(text) > 0").select(F.expr(L.sql_map("ent_type", L.NODE_LABELS, "Entity")).alias("label"), F.col("text").alias("name"))
    return own.unionByName(found).distinct()


def upsert(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """Nodes (label, name, props) merged by label and name: of each property the last write that is not null stays."""
    long = nodes.select("label", "name", order, F.explode_outer("props").alias("key", "value"))
    last = long.groupBy("label", "name", "key").agg(F.max_by(F.col("value"), F.when(F.col("value").isNotNull(), F.col(order))).alias("value"))
    entries = F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))
    return last.groupBy("label", "name").agg(F.map_from_entries(entries).alias("props"))


def mentions(ents: DataFrame) -> DataFrame:
    """Edges from documents to their entities."""
    return ents.where("length(text) > 0").select(F.lit("Document").alias("src_label"), F.col("doc_id").cast("string").alias("src"), F.expr(L.sql_map("ent_type", L.NODE_LABELS, "Entity")).alias("dst_label"), F.col("text").alias("dst"), F.lit("MENTIONS").alias("type")).distinct()


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    src, dst = (nodes.select(F.col("label").alias(f"{x}_label"), F.col("name").alias(x)) for x in ("src", "dst"))
    return edges.join(src, ["src_label", "src"], "left_semi").join(dst, ["dst_label", "dst"], "left_semi").distinct()


def joined_edges(left: DataFrame, right: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """The edges, each once, from left to right (label, name, key) where they share a key and both are nodes.

    Ends are filtered and made distinct before they meet, with all keys of an end in one row. A pair that shares several
    keys is told by the least of them alone, so that pairs, of which there may be many more than ends, aren't shuffled.
    """
    def ends(df: DataFrame, x: str) -> DataFrame:
        held = df.where("key IS NOT NULL").join(nodes, ["label", "name"], "left_semi")
        one = held.groupBy(F.col("label").alias(f"{x}_label"), F.col("name").alias(x)).agg(F.collect_set("key").alias(f"{x}_keys"))
        # Most ends have one key; only of those with several the keys go along.
        return one.select(f"{x}_label", x, F.when(F.size(f"{x}_keys") > 1, F.col(f"{x}_keys")).alias(f"{x}_more"), F.explode(f"{x}_keys").alias("key"))

    first = F.col("src_more").isNull() | F.col("dst_more").isNull() | (F.array_min(F.array_intersect("src_more", "dst_more")) == F.col("key"))
    pairs = ends(left, "src").join(ends(right, "dst"), "key").where(first)
    return pairs.select("src_label", "src", "dst_label", "dst", F.lit(kind).alias("type"))


def pattern(edges: DataFrame, nodes: DataFrame, src_label: str, kind: str, dst_label: str, src: str | None = None) -> DataFrame:
    """(src, dst) of edges of a type between nodes of these labels."""
    out = edges_between(edges.where((F.col("type") == kind) & (F.col("src_label") == src_label) & (F.col("dst_label") == dst_label)), nodes)
    return (out.where(F.col("src") == src) if src is not None else out).select("src", "dst")


def documents_with_entities(docs: DataFrame, edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document with the names of its entities, sorted; documents without any stay."""
    found = edges.where("type = 'MENTIONS' AND src_label = 'Document'").groupBy("src").agg(F.sort_array(F.collect_list(F.concat_ws(":", "dst_label", "dst"))).alias("entities"))
    return docs.join(found, docs[id_col].cast("string") == found["src"], "left").select(docs[id_col], F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def document_vertices(docs: DataFrame, properties: tuple[str, ...] = ("label", "company_id", "date", "file_name"), id_col: str = "doc_id") -> DataFrame:
    """(label, name, props): a vertex for each document, with those of its properties that are there."""
    have = [c for c in properties if c in docs.columns]
    props = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, have)), F.array(*(F.col(c).cast("string") for c in have))), lambda _, v: v.isNotNull()) if have else F.create_map().cast("map<string,string>")
    return docs.select(F.lit("Document").alias("label"), F.col(id_col).cast("string").alias("name"), props.alias("props"))


def relation_edges(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of relations, with the predicate as their property: between nodes labelled Entity, as both ends are looked up so."""
    edge = rels.select(F.lit("Entity").alias("src_label"), F.col("subject").alias("src"), F.lit("Entity").alias("dst_label"), F.col("object").alias("dst"), F.col("relation_type").alias("type"), "predicate")
    return edges_between(edge, nodes)


def graph(docs: DataFrame, ents: DataFrame, rels: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The property graph: (label, name) of all nodes, and edges, mentions and relations."""
    nodes = vertices(docs, ents, id_col)
    both = mentions(ents).unionByName(relation_edges(rels, nodes).drop("predicate"))
    return nodes, both


def query_graph(nodes: DataFrame, edges: DataFrame, sql: str, **parameters) -> DataFrame:
    """Any SQL over the views {vertices} and {edges}; :name stands for a parameter."""
    return nodes.sparkSession.sql(sql, parameters or None, vertices=nodes, edges=edges)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes of each label and edges of each type."""
    one = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return one.unionByName(edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def with_chunks(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document with the ids of its chunks in order, their number, and its content rejoined from them."""
    own = chunks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("c"))
    told = docs.join(own, id_col, "left")
    content = F.when(F.col("c").isNull(), "No content available").otherwise(F.array_join(F.transform("c", lambda x: x["text"]), " "))
    ids = F.coalesce(F.transform("c", lambda x: x["chunk_id"]), F.array().cast("array<string>"))
    return told.withColumns({"content": content, "chunk_ids": ids, "chunk_count": F.size(ids)}).drop("c")


def rejoined(chunks: DataFrame) -> DataFrame:
    """Documents' content from their chunks, in order."""
    lists = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return lists.select("doc_id", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("content"))
