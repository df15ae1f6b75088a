"""Token alignment against whole-text tokenisation with the tokenizer files and sets of byte offsets."""

import functools
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from finsift.llm import align

PATHS = [align.vocabulary(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
ODD = ["", " ", "  two  blanks ", "a\n\nb \n c", "a\tb\x0cc \x1cd", "▁", "a▁b c", "<|endoftext|> <s> <unk> <0x41>", "日本語 の テキスト", "ﬁ① é é", "x\x00y \x00", "🙂🙂 👩‍👩‍👧", "na ïve  end", "a" * 3000, " " * 2000 + "x", "word. Word, word's wouldn't I'll 12345 1,234.5", "\n", "\nx", "x\n", "end ", "q́ ́", "Ünï çödé ß", "x \u0085 y"]


@functools.cache
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    table = align.byte_level()
    spell_a = lambda i: bytes(table[c] for c in t.id_to_token(i))
    spell_b = lambda i: bytes((int(sp.id_to_piece(i)[3:5], 16),)) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return t, sp, spell_a, spell_b


def brute(text):
    """(ids, ids, groups) by sets of offsets; None without tokens."""
    if not text:
        return None
    t, sp, spell_a, spell_b = tools()
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    x, y = [spell_a(i) for i in a], [spell_b(i) for i in b]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return None
    offsets = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 50 else _sums(parts)
    ends_a, ends_b = offsets(x), offsets(y)
    groups, i, j = [], 0, 0
    for at in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(at, i) + 1, ends_b.index(at, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return a, b, groups


def _sums(parts):
    out, total = [], 0
    for p in parts:
        total += len(p)
        out.append(total)
    return out


def expected(texts):
    told = {k: brute(t) for k, t in texts}
    counts = Counter((g[0][-1], g[1][-1]) for x in told.values() if x for g in x[2])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = {}
    for k, x in told.items():
        if x is None:
            out[k] = (0, 0, 0, 0, 0, 0, "")
            continue
        links = [(g[0][-1], g[1][-1]) for g in x[2]]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2])
        out[k] = (len(x[0]), len(x[1]), len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = ["the", "einen", "ungäte", "THESNDST.!!", "don't", "x=1;", "naïve", "日本", "12", "?!"]
    made = [draw.choice([" ", " ", "  ", "\n"]).join(draw.choice(words) + draw.choice(["", ".", ",", "ly"]) for _ in range(draw.randrange(1, 80))) for _ in range(120)]
    return list(enumerate([*ODD, *made, made[0]]))


def test_rows_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts] + [(-1, None, "x", 1)], "doc_id long, text string, n_a string, pair int").repartition(3)
    want = expected(texts) | {-1: (0, 0, 0, 0, 0, 0, "")}
    own = align.aligner(*PATHS)
    links = align.written_at(align.aligned(docs, *PATHS, spelled=True), "links")[0]
    counts = align.written_at(align.pair_counts(links, own.n_b, own.kind.str, most=50), "counts")[0]
    for most in (align.MAP_PAIRS, 0):  # by a table in the tasks, by a join
        got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_groups, r.n_best, r.count_sum, r.groups_sha256) for r in align.scored(links, counts, own.kind.str, most).collect()}
        assert got == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in links.where("n_groups > 0").collect())


def test_query(spark, texts, tmp_path):
    spark.createDataFrame([*texts, (None, "again and again")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in align.op13_token_alignment(spark, str(tmp_path)).collect()}
    assert got == expected([*texts, (None, "again and again")])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert align.op13_token_alignment(spark, str(tmp_path)).count() == 0


def test_transducer():
    a, b = [b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"x"]
    t = align.Transducer(a, b)
    assert t.groups([0, 1, 3], [2]) == ([3], [1]) and t.groups([0, 1], [0, 1]) == ([2], [2])
    assert t.groups([2, 0, 1], [0, 1, 0, 1]) == ([1, 3], [2, 4])
    assert t.groups([0], [3]) is None and t.groups([0], [0]) is None and t.groups([0, 1], [0]) is None
    assert {s for s in t.suffix if s[1]} <= {(True, b"b"), (False, b"cd"), (False, b"d"), (False, b"c"), (True, b"bc"), (False, b"a"), (True, b"a")}


def test_parts_are_remembered_and_forgotten(monkeypatch):
    own = align.Aligner(align.ByteSide(PATHS[0], PATHS[2]), align.PieceSide(PATHS[1]))
    first = own.texts(["one two three one", "four"])
    assert own.cache.keys() == {"one", "two", "three", "four"}
    monkeypatch.setattr(align, "CACHE_BYTES", 1)
    assert own.texts(["one two three one", "four"]) == first and not own.cache
    assert own.texts(["one two three one"]) == first[:1] and not own.cache


def test_both_libraries_agree(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("text").isNotNull()).select("text").limit(100).collect()]
    own = align.aligner(*PATHS)
    for t in texts:
        assert own.first.ids(t) == own.first.slow.encode(" " + t, add_special_tokens=False).ids
