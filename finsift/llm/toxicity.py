"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, are trained from document labels.

A sentence's score is a logistic function of the words, and beginnings of words, that it holds; a document is toxic unless none of its sentences is:
P = 1 - prod(1 - p_s). The gradient of the document's loss reaches the sentences that explain it, so that the model
also locates offending sentences, which no label names. Words are runs of letters, A-Z lower-cased.

Null and empty texts, and texts without words, are one sentence without words; they get the score that the bias
alone gives. Rows without a label are not learned from; without labelled rows every score is near 0. A document with
several labels counts as toxic if one says so. Rows are judged one by one, whole and at any length. Added columns
replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._bytes import LETTER, LOWER, U, blocks, mix, raw, trim, word_hashes
from finsift.llm._shared import crc_mod, fresh, read, written

#: Lengths, in bytes, of the word beginnings that count beside whole words.
HEADS = (5, 6, 7)
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class ToxicModel:
    words: np.ndarray  # hashes, sorted
    weights: np.ndarray
    bias: float


def word_heads(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n bytes of the words that are longer, and which words those are."""
    long = np.flatnonzero(starts + n < len(data))
    reach = starts[long][:, None] + np.arange(n + 1)
    long = long[LETTER[data[reach]].all(1)] if len(long) else long
    total = np.zeros(len(long), U)
    for k in range(n):
        total = total * U(0xD6E8FEB86659FD93) + LOWER[data[starts[long] + k]].astype(U)
    return mix(total + U(n << 56)), long


def sentence_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: number of texts, word hashes, row and sentence of each word, and each sentence's row and start."""
    data, at = raw(texts)
    for i, j in blocks(at):
        own, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
        hashes, starts, bounds = word_hashes(own, off, LETTER)
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        ended = np.cumsum(_END[own]) if len(own) else np.zeros(0, np.int64)
        mark = ended[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
        sentence = np.cumsum(new) - 1
        heads = [(hashes, row, sentence)]
        for n in HEADS:  # the first n bytes of longer words, as words with their own stem
            head, long = word_heads(own, starts, n)
            heads.append((head, row[long], sentence[long]))
        hashes, all_rows, all_sentences = (np.concatenate(x) for x in zip(*heads, strict=True))
        yield j - i, hashes, all_rows, all_sentences, row[new], starts[new] - off[row[new]]


def hits(hashes: np.ndarray, sentence: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, word number), each pair once."""
    if not len(words) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    is_word = words[at] == hashes
    pair = np.unique(sentence[is_word] * len(words) + at[is_word])
    return pair // len(words), pair % len(words)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, fit_bytes: int = 128 << 20, vocabulary: int = 2048, min_docs: int = 4, steps: int = 250, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> ToxicModel:
    """Learn from docs that labels (doc_id, toxic) mark.

    The classifier is fitted on a bounded sample: about fit_rows labelled documents and fit_bytes of text, chosen by a
    hash of the id. Of the words in at least min_docs of them, the `vocabulary` ones that tell most are used, a quarter
    of them words that speak against toxicity. A document with several labels is toxic if one says so; one with several
    rows is as many examples.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("y"))
    number = known.count()
    share = min(1.0, fit_rows / max(1, number))
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity")).bitwiseAND(F.lit((1 << 20) - 1))
    sample = docs.where(draw < F.lit(share * (1 << 20))).select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(known, "label_id").select("label_id", "text", "y")
    sample = written(sample.withColumn("row", F.xxhash64("text", "label_id")), "sample")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > fit_bytes:
        sample = sample.where(F.col("row").bitwiseAND(F.lit((1 << 20) - 1)) < F.lit(fit_bytes / size * (1 << 20)))
    sample = sample.select("text", "y")

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, done = batch.column(1).to_numpy(), 0
            for n, hashes, row, *_ in sentence_words(batch.column(0)):
                order = np.lexsort((hashes, row))
                h, r = hashes[order], row[order]
                one = np.ones(len(h), bool)
                one[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                words, place = np.unique(h[one], return_inverse=True)
                toxic = np.bincount(place, y[done : done + n][r[one]], len(words)) if len(words) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(place, minlength=len(words)).astype(np.int64)), pa.array(toxic.astype(np.int64))], ["h", "n", "t"])
                done += n

    rate = sample.agg(F.avg("y")).first()[0] or 0.0
    counted = sample.mapInArrow(word_counts, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    over = F.col("t") - F.col("n") * F.lit(rate)
    ranked = counted.where(F.col("n") >= min_docs).withColumn("gain", over * over / (F.col("n") * F.lit(max(rate, 1e-9))))
    told = [ranked.where(which).orderBy(F.desc("gain"), "h").limit(most).select("h").toPandas()["h"].to_numpy(np.int64) for which, most in ((over > 0, vocabulary - vocabulary // 4), (over < 0, vocabulary // 4))]
    words = np.sort(np.concatenate(told).view(U))
    sent = docs.sparkSession.sparkContext.broadcast(words)  # at most vocabulary

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, done = batch.column(1).to_numpy(), 0
            for n, hashes, _, sentence, s_row, _ in sentence_words(batch.column(0)):
                s, w = hits(hashes, sentence, sent.value)
                number = np.bincount(s_row, minlength=n)
                rows = s_row[s]
                cut = np.searchsorted(rows, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[done : done + n], pa.int32()), pa.array(np.maximum(number, 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(s.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(w.astype(np.int32)))],
                    ["y", "n", "s", "w"],
                )
                done += n

    got = sample.mapInArrow(instances, "y int, n int, s array<int>, w array<int>").toPandas()  # about fit_rows rows
    return train(got, words, steps)


def train(got, words: np.ndarray, steps: int, l2: float = 1e-4, rate: float = 0.2) -> ToxicModel:
    y = got["y"].to_numpy(float)
    n = len(y)
    weights, bias = np.zeros(len(words)), -4.0
    if not n:
        return ToxicModel(words, weights, -8.0)
    doc = np.repeat(np.arange(n), [len(x) for x in got["s"]])
    s = np.concatenate([*got["s"], np.zeros(0, np.int32)]).astype(np.int64)
    w = np.concatenate([*got["w"], np.zeros(0, np.int32)]).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    inst = np.cumsum(new) - 1
    owner = doc[new]
    bare = got["n"].to_numpy(float) - np.bincount(owner, minlength=n)
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(inst, weights[w], len(owner)) if len(w) else np.full(len(owner), bias)
        log_none = -np.bincount(owner, np.logaddexp(0, z), n) - bare * np.logaddexp(0, bias)
        none = np.exp(np.minimum(log_none, -1e-9))
        slope = np.where(y > 0, -none / (1 - none), 1.0) / n
        p = 1 / (1 + np.exp(-z))
        dz = slope[owner] * p
        grad = np.append(np.bincount(w, dz[inst], len(words)) + l2 * weights, dz.sum() + (slope * bare).sum() / (1 + np.exp(-bias)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], float(bias - move[-1])
    return ToxicModel(words, weights, bias)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", score_to: str = "score", sentences_to: str = "offending") -> DataFrame:
    """docs with the score, and the sentences of score 0.5 or more: start (in UTF-8 bytes) and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())])))])

    @F.arrow_udf("score double, offending array<struct<start: bigint, score: double>>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in batches:
            scores, bad = [], []
            for n, hashes, _, sentence, s_row, s_start in sentence_words(texts):
                s, w = hits(hashes, sentence, model.words)
                z = model.bias + np.bincount(s, model.weights[w], len(s_row)) if len(s) else np.full(len(s_row), model.bias)
                none = -np.bincount(s_row, np.logaddexp(0, z), n) if len(z) else np.zeros(n)
                none[np.bincount(s_row, minlength=n) == 0] = -np.logaddexp(0, model.bias)
                scores.append(np.clip(1 - np.exp(none), 0, 1))
                p = 1 / (1 + np.exp(-z))
                out = [[] for _ in range(n)]
                for k in np.flatnonzero(p >= 0.5):
                    out[s_row[k]].append({"start": int(s_start[k]), "score": float(p[k])})
                bad += out
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(bad, kind.field(1).type)], fields=list(kind))
        trim()

    made = fresh([*docs.columns, score_to, sentences_to], "judged")
    return docs.withColumn(made, judge(F.col(f"`{text_col}`"))).withColumns({score_to: F.col(made)["score"], sentences_to: F.col(made)["offending"]}).drop(made)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
