"""Language identification with bit-sliced Bloom filters over byte n-grams.

One table of masks serves all languages: bit l of a slot belongs to language l, so that AND-ing the slots of an
n-gram's hashes returns the set of all languages that contain it. A text's hits are counted for each language,
corrected for the rate of false positives that the filling of its bit plane implies, and the largest corrected
count decides (ties: the language that sorts first).

Null texts and texts without a letter are `und` with score 0. A text with a letter but without a hit gets the language
with the most training rows, with score 0. Rows are judged one by one: repeated rows get equal
results, an empty table gives an empty result, long texts are read whole. Training skips rows without text or
language; with no training rows every text is `und`. An added column replaces a column of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finsift.llm._bytes import LETTER, U, blocks, mix, raw, trim
from finsift.llm._shared import crc_mod, fresh, read, small_batches

GRAMS = (2, 3, 4)
#: Bytes of masks that are sent to the executors, about.
MASK_BYTES = 64 << 20
#: The bits of each byte, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, the masks (one column of 64 languages each) and the false-positive rate of each language."""

    languages: tuple[str, ...]
    masks: np.ndarray
    rates: np.ndarray
    hashes: int
    usual: int = -1


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with each run of non-letters as one blank, and the texts' offsets."""
    data, at = raw(pc.utf8_lower(texts))
    if not len(data):
        return data, at
    letter = LETTER[data]
    before = np.concatenate([[False], letter[:-1]])
    before[at[(at < len(data))]] = True  # each text begins with a blank or a letter
    keep = letter | before
    total = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, data, 0x20).astype(np.uint8)[keep], total[at]


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the code of every n-gram and the row of its text."""
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), counts)
    code = data.astype(U)
    for n in range(2, max(GRAMS) + 1):
        code = (code[:-1] << U(8)) | data[n - 1 :].astype(U)
        if n in GRAMS and len(code):
            whole = row[: len(code)] == row[n - 1 :]
            yield code[whole], row[: len(code)][whole]


def slots(code: np.ndarray, hashes: int, size: int) -> Iterator[np.ndarray]:
    h = mix(code)
    step = (h >> U(32)) | U(1)
    for i in range(hashes):
        yield ((h + U(i) * step) & U(size - 1)).astype(np.int64)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (lang, code, n), added up within blocks."""
    for batch in batches:
        for lang in pc.unique(batch.column(1)).to_pylist():
            texts = batch.column(0).filter(pc.equal(batch.column(1), lang))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for i, j in blocks(np.concatenate([[0], np.cumsum(sizes)])):
                found = [c for c, _ in grams(*folded(texts.slice(i, j - i)))]
                if found:
                    codes, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])
    trim()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 2000, grams_per_language: int = 4096, slots_bits: int = 17, hashes: int = 4, min_share: float = 0.3) -> LanguageModel:
    """Learn from rows with text and language.

    The classifier is fitted on a bounded sample: about rows_per_language rows of each language, chosen by a hash of
    the id. An n-gram belongs to each language in which its relative frequency is at least min_share of its highest.
    Frequencies count all n-grams of the sample; of those that belong to a language, its grams_per_language most
    frequent ones are used, whatever the number and sizes of the other languages.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    languages = tuple(sorted(counts))
    size = 1 << slots_bits
    wide = -(-max(1, len(languages)) // 64)
    while size * wide * 8 > MASK_BYTES and size > 1 << 10:  # fuller planes: the rates of false positives follow
        size //= 2
    masks = np.zeros((size, wide), U)
    if languages:
        share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / counts[lang]))])
        draw = (F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")) % F.lit(1 << 20) + F.lit(1 << 20)) % F.lit(1 << 20)
        sample = labelled.where(draw < share[F.col(lang_col)] * F.lit(float(1 << 20))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        summed = sample.mapInArrow(count_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        total = summed.groupBy("lang").agg(F.sum("n").alias("total"))
        rated = summed.join(F.broadcast(total), "lang").select("lang", "code", "n", (F.col("n") / F.col("total")).alias("rate"))
        most = rated.groupBy("code").agg(F.max("rate").alias("most"))
        own = rated.join(most, "code").where(F.col("rate") >= F.lit(min_share) * F.col("most"))
        ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code")))
        with small_batches(docs.sparkSession):  # whole texts go to the tasks
            top = ranked.where(F.col("rank") <= grams_per_language).select("lang", "code").toPandas()
        lang_no = top["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
        code = top["code"].to_numpy().astype(U)
        for i in range(len(languages)):
            for slot in slots(code[lang_no == i], hashes, size):
                masks[slot, i // 64] |= U(1 << (i % 64))
    filled = np.array([np.mean((masks[:, i // 64] >> U(i % 64)) & U(1)) for i in range(len(languages))])
    usual = max(range(len(languages)), key=lambda i: (counts[languages[i]], -i), default=-1)
    return LanguageModel(languages, masks, filled**hashes, hashes, usual)


def judge(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language (without a hit the usual one) and its share of the corrected counts."""
    best, score = [], []
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, j in blocks(np.concatenate([[0], np.cumsum(sizes)])):
        data, at = folded(texts.slice(i, j - i))
        hits = np.zeros((j - i, len(model.languages)))
        number = np.zeros(j - i)
        for code, row in grams(data, at):
            found = None
            for slot in slots(code, model.hashes, len(model.masks)):
                found = model.masks[slot] if found is None else found & model.masks[slot]
            number += np.bincount(row, minlength=j - i)
            # Eight languages at a time: how often each value of their byte occurs in a text, times the bits it has set.
            planes = found.astype("<u8").view(np.uint8).reshape(len(found), -1)
            for k in range(0, len(model.languages), 8):
                seen = np.bincount(row * 256 + planes[:, k // 8], minlength=(j - i) * 256).reshape(j - i, 256)
                hits[:, k : k + 8] += (seen @ BITS)[:, : hits.shape[1] - k]
        true = np.maximum(0, (hits - number[:, None] * model.rates) / (1 - np.minimum(model.rates, 0.99)))
        total = true.sum(1)
        top = true.argmax(1) if len(model.languages) else np.zeros(j - i, int)
        best.append(np.where(total > 0, top, model.usual))
        score.append(np.where(total > 0, true[np.arange(j - i), top] / np.maximum(total, 1e-12), 0.0) if len(model.languages) else np.zeros(j - i))
    return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """docs with the predicted language and its score, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        names = pa.array([*m.languages, None], pa.string())
        for texts in batches:
            best, score = judge(m, texts)
            yield pa.StructArray.from_arrays([names.take(pa.array(np.where(best < 0, len(m.languages), best), pa.int64())), pa.array(score, pa.float64())], fields=list(kind))
        trim()

    text: Column = F.col(f"`{text_col}`")
    told = fresh(docs.columns, "language_told")
    has = fresh([*docs.columns, told], "has_letter")
    out = docs.withColumn(has, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).withColumn(told, language(text))
    out = out.withColumns({lang_to: F.when(F.col(has), F.coalesce(F.col(told)["lang"], F.lit("und"))).otherwise("und"), score_to: F.when(F.col(has), F.col(told)["score"]).otherwise(0.0)})
    return out.drop(told, has)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
