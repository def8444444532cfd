import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from turnweave.llm import queries, tokens
from turnweave.llm.common import scratch_path, table

JSON = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(JSON)
DOCS = "doc_id long, text string, digest string, n_tokens int, tokenizer string"


def plain(text):
    return len(PLAIN.encode(text or "", add_special_tokens=False).ids)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", -1, "clash") for i, t in rows], DOCS)


def test_query_equals_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op12_digest_cache(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        n = plain(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 1024)


SPACES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "　", "\x1c", "\x85", "​", "᠎", "﻿"])
WORDS = st.sampled_from(["it's", "'s", "Über", "x", "42", "²", "...", "!?", "<|endoftext|>", "<|endof", "é", "é", "語", "🙂", "٠", "_", "I'LL", "a" * 50])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(SPACES, WORDS, st.characters(exclude_categories=["Cs"])), max_size=25))
def test_pieces_add_up(parts):
    text = "".join(parts)
    assert counter([text]) == [plain(text)]


counter = tokens.Counter("tokenizers", open(JSON, "rb").read())


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    c = tokens.Counter("tokenizers", open(JSON, "rb").read())
    for t in ("a b c d e f", "g h", "a b c d"):
        assert c([t, ""]) == [plain(t), 0]


def test_edges(spark):
    long = "word <|endoftext|>\n\n " * 40_000
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "same text"), (4, long), (5, "x" * 100_000), (6, " \n ")]
    got = tokens.counts(docs_of(spark, rows), scratch_path(spark, "t")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or -1, len((t or "").encode()), plain(t), plain(t) > 1024) for i, t in rows)
    assert tokens.counts(docs_of(spark, []), scratch_path(spark, "t")).collect() == []
    at_limit = " a" * 1024
    got = tokens.counts(docs_of(spark, [(1, at_limit), (2, at_limit + " a")]), scratch_path(spark, "t")).collect()
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in got} == {1: (1024, False), 2: (1025, True)}


@pytest.mark.parametrize("few", [0, 1000])
def test_cache_keeps_and_grows(spark, monkeypatch, few):
    """Hits are taken as stored, only misses are encoded, and two appends of one text are one."""
    monkeypatch.setattr(tokens, "FEW", few)
    at = scratch_path(spark, "t")
    assert tokens.counts(docs_of(spark, [(1, "one two"), (2, "three")]), at).count() == 2
    cache = spark.read.schema(tokens.CACHE).parquet(at)
    assert cache.count() == 2
    _, _, version = tokens.load(JSON)
    marked = docs_of(spark, [(0, "stored")]).select(tokens.content_digest(tokens.F.col("text")).alias("digest")).selectExpr("digest", "6L as n_bytes", "777L as n_tokens", f"'{version}' as tokenizer")
    for _ in range(2):
        marked.write.mode("append").partitionBy("tokenizer").parquet(at)
    got = {r.doc_id: r.n_tokens for r in tokens.counts(docs_of(spark, [(1, "one two"), (5, "stored"), (6, "stored"), (7, "new one")]), at).collect()}
    assert got == {1: plain("one two"), 5: 777, 6: 777, 7: plain("new one")}
    assert spark.read.schema(tokens.CACHE).parquet(at).count() == 5
    other = {r.doc_id: r.n_tokens for r in tokens.counts(docs_of(spark, [(5, "stored")]), at, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert other[5] != 777


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    texts = ["Hello  World it's\n\nme", "", "日本語 <|endoftext|> </s> x", "a" * 3000, " lead"]
    if name.endswith(".json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    else:
        import sentencepiece

        want = list(map(len, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(texts)))
    got = tokens.counts(docs_of(spark, list(enumerate(texts))), scratch_path(spark, "t"), public_tokenizers.path(name)).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_unknown_file_raises():
    with pytest.raises((ValueError, FileNotFoundError)):
        tokens.load(public_tokenizers.path("LICENSES.txt"))
