"""Text functions: cleaning, sentences, chunks, HTML, file names and containers. All but HTML are native expressions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsift.functions.numeric import _let


def clean(text: Column) -> Column:
    """White space to single blanks; symbols but for basic punctuation go; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)[^\w\s\.,;:!?()-]", ""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    # A lambda of one parameter: F.trim itself has two, so transform() would pass the index as the characters to cut off.
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def each_item(df: DataFrame, keep: Column, array: Column, place: str, item: str) -> DataFrame:
    """(keep, place, item): a row for each item of a computed array, none where it is null or empty.

    An inner explode makes Spark filter by the array's size first, and so compute it again for the filter.
    """
    return df.select(keep, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())


def chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Array of (chunk_index, text, length): sentences packed up to size words, with the last overlap words repeated.

    One fold over the sentences, in order. A sentence longer than size is a chunk of its own. Sizes count words.
    """
    kind = "array<struct<text: string, length: int>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def closed(state: Column) -> Column:
        return F.concat(state["done"], F.array(F.struct(F.array_join(state["cur"], " ").alias("text"), state["n"].alias("length"))))

    def next_chunk(state: Column, sentence: Column) -> Column:
        every = words(F.array_join(state["cur"], " "))
        tail = _let(every, lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - (overlap - 1)), F.lit(overlap))) if overlap else every
        return _let(tail, lambda w: F.struct(closed(state).alias("done"), F.array(F.array_join(w, " "), sentence["s"]).alias("cur"), (F.size(w) + sentence["n"]).alias("n")))

    def step(state: Column, sentence: Column) -> Column:
        full = (state["n"] + sentence["n"] > size) & (F.size(state["cur"]) > 0)
        longer = F.struct(state["done"].alias("done"), F.concat(state["cur"], F.array(sentence["s"])).alias("cur"), (state["n"] + sentence["n"]).alias("n"))
        return F.when(full, next_chunk(state, sentence)).otherwise(longer)

    counted = F.transform(sentences(clean(text)), lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n")))
    return F.aggregate(counted, start, step, lambda state: F.when(F.size(state["cur"]) > 0, closed(state)).otherwise(state["done"]))


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, length)."""
    out = each_item(docs, F.col(id_col).alias("doc_id"), chunks(F.col(text_col), size, overlap), "chunk_index", "c")
    return out.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "c.text", "c.length")


def html_to_text(html: Column) -> Column:
    """Text of a page, as a parser reads it: scripts, styles and comments go, all entities are read, inline tags join.

    Lines are cut at double blanks and trimmed, blank ones dropped; what then still looks like a tag goes.
    """
    return _parsed_html()(html)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def _read_html(page: str) -> str:
    parser = _Text()
    parser.feed(page)
    parser.close()
    lines = (x.strip() for line in "".join(parser.found).splitlines() for x in line.strip().split("  "))
    return re.sub(r"<[^>]+>", "", "\n".join(x for x in lines if x)).strip()


def _parsed_html():
    @F.pandas_udf("string")
    def parsed(pages: pd.Series) -> pd.Series:
        return pages.map(_read_html, na_action="ignore")

    return parsed


def file_name_metadata(name: Column) -> dict[str, Column]:
    """label, company_id, date and submission_id of a file's stem; label is `unknown` where the name says nothing."""
    # The names that loaded files have.
    known, other = r"^(NonFraud|Fraud)_(\d+)_(\d{8})_(\d+)", r"^Unknown_full-submission_(\d+)"
    part = lambda p, g: F.nullif(F.regexp_extract(name, p, g), F.lit(""))
    return {
        "label": F.coalesce(F.lower(part(known, 1)), F.lit("unknown")),
        "company_id": part(known, 2),
        "date": part(known, 3),
        "submission_id": F.coalesce(part(known, 4), part(other, 1)),
    }


def path_metadata(path: Column) -> dict[str, Column]:
    """category, year, cik, date, filing_type and accession of a filing's path below the base folder.

    Non Fraudulent Dataset/year/cik_date.txt, or Fraudulent Dataset/source/cik/filing type/accession/file.
    """
    parts = F.split(path, "/")
    n = F.size(parts)
    clean, fraud = path.contains("Non Fraudulent Dataset"), path.contains("Fraudulent Dataset")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    of_name = lambda g: F.when(clean & (n >= 2), F.nullif(F.regexp_extract(stem, r"^(\d+)_(\d{8})", g), F.lit("")))
    of_path = lambda i: F.when(~clean & fraud & (n >= 5), F.get(parts, i))
    return {
        "category": F.when(clean, "Non Fraudulent").when(fraud, "Fraudulent"),
        "year": F.when(clean & (n >= 2) & F.get(parts, 1).rlike(r"^\d+$"), F.get(parts, 1)),
        "cik": F.coalesce(of_name(1), of_path(2)),
        "date": of_name(2),
        "filing_type": of_path(3),
        "accession": of_path(4),
    }


def unique_name(category: Column, cik: Column, date: Column, filing_type: Column, accession: Column, stem: Column, counter: Column) -> Column:
    """The name of an extracted file; empty fields count as missing."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    dashed = lambda c: F.replace(c, F.lit("/"), F.lit("-"))
    filing = F.when(has(filing_type), dashed(filing_type)).otherwise("UNKNOWN")
    middle = (
        F.when((category == "Non Fraudulent") & has(cik) & has(date), F.concat_ws("_", cik, date))
        .when((category == "Fraudulent") & has(cik) & has(accession), F.concat_ws("_", cik, filing, dashed(accession)))
        .otherwise(stem)
    )
    kind = F.when(category == "Non Fraudulent", "NonFraud").when(category == "Fraudulent", "Fraud").otherwise("Unknown")
    return F.concat(F.concat_ws("_", kind, middle, counter.cast("string")), F.lit(".txt"))


def type_banner(kind: Column, body: Column) -> Column:
    """A document's text under a banner that names its type."""
    line = F.lit("=" * 70 + "\n")
    return F.concat(line, F.lit("DOCUMENT TYPE: "), kind, F.lit("\n"), line, F.lit("\n"), body, F.lit("\n\n"))


def node_id(kind: Column, text: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.replace(text, F.lit(" "), F.lit("_")))


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


UNITS = ("B", "KB", "MB", "GB", "TB")


def byte_size(number: Column, units: tuple[str, ...] = UNITS) -> Column:
    """A number of bytes in the unit that keeps it below 1024, or the last one, with two places."""
    steps = F.least(F.lit(len(units) - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.abs(number.cast("double")), F.lit(1.0))) / 10)))
    unit = F.element_at(F.array(*map(F.lit, units)), (steps + 1).cast("int"))
    return F.concat(F.format_string("%.2f ", F.bround(number.cast("double") / F.pow(F.lit(1024.0), steps), 2)), unit)


def term_places(low: Column, term: str) -> Column:
    """Where, from 0, each non-overlapping hit of term in lower-case text begins."""
    parts = F.split(low, r"\Q" + term + r"\E", -1)
    step = lambda a, x: F.struct((a["at"] + F.length(x) + len(term)).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(x))).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda a: a["found"])


def match_places(text: Column, found: Column) -> Column:
    """Where, from 0, each of the consecutive matches `found` of a pattern begins: each after the end of the one before."""
    def step(a: Column, x: Column) -> Column:
        at = F.call_function("locate", x, text, a["at"] + 1) - 1
        return F.struct((at + F.length(x)).alias("at"), F.concat(a["found"], F.array(at)).alias("found"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), step, lambda a: a["found"])


def smart_split(text: Column, most: int = 500_000) -> Column:
    """Pieces of a text: paragraphs packed in order while their lengths sum to at most `most` characters.

    A longer paragraph is cut into its sentences, packed likewise, the last pack going on with the next paragraphs. A
    text that fits, and a single sentence that doesn't, is one piece. Separators don't count.
    """
    none = F.array().cast("array<string>")

    def pack(a: Column, item: Column) -> Column:
        """Adds an item to the open pack, or to a new one."""
        fits = a["size"] + F.length(item) <= most
        flush = ~fits & (F.size(a["now"]) > 0)
        done = F.when(flush, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(fits, F.concat(a["now"], F.array(item))).otherwise(F.array(item)).alias("now"), F.when(fits, a["size"] + F.length(item)).otherwise(F.length(item)).alias("size"))

    def start() -> Column:
        return F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("now"), F.lit(0).alias("size"))

    def sentence_packs(paragraph: Column) -> Column:
        return F.aggregate(F.split(paragraph, r"\. "), start(), pack, lambda a: F.concat(a["done"], F.array(a["now"])))

    def step(a: Column, paragraph: Column) -> Column:
        cut = (a["size"] + F.length(paragraph) > most) & (F.length(paragraph) > most)
        packs = sentence_packs(paragraph)
        whole = F.transform(packs, lambda x: F.array(F.concat(F.array_join(x, ". "), F.lit("."))))
        before = F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        inside = F.struct(F.concat(before, F.slice(whole, 1, F.size(whole) - 1)).alias("done"), F.element_at(whole, -1).alias("now"), F.aggregate(F.element_at(packs, -1), F.lit(0), lambda n, x: n + F.length(x)).alias("size"))
        return F.when(cut, inside).otherwise(pack(a, paragraph))

    packed = F.aggregate(F.split(text, "\n\n"), start(), step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.transform(packed, lambda x: F.array_join(x, "\n\n")))


def filing_documents(filings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, type, body) of each <DOCUMENT> with a <TEXT>."""
    inside = F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))).alias("ord", "inner")
    out = filings.select(id_col, inside).where(F.col("inner").rlike(r"(?s)<TEXT>.*?</TEXT>"))
    return out.select(id_col, "ord", F.trim(F.regexp_extract("inner", r"<TYPE>([^\n]*)\n", 1)).alias("type"), F.regexp_extract("inner", r"(?s)<TEXT>(.*?)</TEXT>", 1).alias("body"))


def first_digit(number: Column) -> Column:
    """The first digit other than 0 of a number's text, as an int; null where there is none."""
    digits = F.regexp_replace(F.regexp_replace(number.cast("string"), "[^0-9]", ""), "^0+", "")
    return F.substring(digits, 1, 1).try_cast("int")
