"""Token counts of whole texts, kept in a cache by digests of content and tokenizer.

A count is looked up by the digest of the normalised content (null is the empty text; the tokenizers used here tell any other two texts
apart, so nothing else is folded) and the digest of the tokenizer: its file's bytes with the name and version of its library. Texts
that the cache lacks are encoded once each, however many documents hold them, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, spread_join, written

CACHE = "digest binary, n_bytes long, n_tokens long, tokenizer string"
#: Missing digests (32 bytes each) up to this count are sent to all tasks, so that only their texts are shuffled; beyond, all distinct texts are.
FEW = 200_000
#: Counts of pieces that a Python worker remembers; the memory is emptied at this size.
REMEMBERED = 500_000
#: White space and what is bound to follow it up to the next white space. Byte-level patterns end a match there wherever they are.
PIECE = re.compile(r"\s*\S+|\s+")
#: Characters that not every library takes for white space or for anything else: texts that hold one stay in one piece.
UNSURE = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\u2060\\ufeff]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str) -> tuple[str, bytes, str]:
    """(library, the file's bytes, digest of the tokenizer's version) for a .json or .model file, which only the driver needs to see."""
    with open(path, "rb") as f:
        raw = f.read()
    if path.endswith(".json"):
        import tokenizers as library
    elif path.endswith(".model"):
        import sentencepiece as library
    else:
        raise ValueError(f"{path}: only .json (tokenizers) and .model (sentencepiece) files are known")
    name = library.__name__
    return name, raw, hashlib.sha256(f"{name} {library.__version__}\n".encode() + raw).hexdigest()


def _splits(raw: bytes) -> bool:
    """Whether a tokenizers file counts a text as the sum of its PIECEs: byte level with the usual pattern, and nothing around it that looks across white space."""
    d = json.loads(raw)
    before, added = d.get("pre_tokenizer") or {}, d.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not d.get("normalizer")
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)


class Counter:
    """Counts of tokens by a library, without begin, end or other added special tokens; special strings in a text as the library takes them by default."""

    def __init__(self, library: str, raw: bytes):
        self.known: dict[str, int] = {}
        if library == "tokenizers":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(raw.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.splits = _splits(raw)
            self.encode: Callable[[list[str]], list] = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        else:
            from sentencepiece import SentencePieceProcessor

            tokenizer = SentencePieceProcessor(model_proto=raw)
            self.splits = False
            self.encode = lambda texts: tokenizer.encode(texts, num_threads=1)

    def __call__(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text; where the tokenizer allows it a text is the sum of its pieces, each distinct one encoded once."""
        if not self.splits:
            return [len(x) for x in self.encode(texts)]
        pieces = [[t] if UNSURE.search(t) else PIECE.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for ps in pieces for p in ps}.difference(self.known))
        for i in range(0, len(new), 10_000):
            self.known.update(zip(new[i : i + 10_000], map(len, self.encode(new[i : i + 10_000])), strict=True))
        return [sum(map(self.known.__getitem__, ps)) for ps in pieces]


_loaded: dict[str, Counter] = {}


def content_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_bytes, n_tokens), one row per digest, of what the cache holds for a tokenizer; two jobs may have appended the same text."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_bytes").alias("n_bytes"), F.min("n_tokens").alias("n_tokens"))


def counts(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text; other columns play no part).

    ``cache``: a folder of Parquet that all executors share, by default one in the session's shared folder, which later calls find
    again; ``tokenizer``: path of a .json or .model file. Null texts count as empty: no bytes, no tokens. Repeated rows each get their
    row, rows without a doc_id too; an empty table gives an empty one. Texts are encoded whole, in pieces whose counts add up where the
    tokenizer allows that. A text with very many copies is one row before anything is shuffled, and the join with the counts deals it out.
    Files are appended as Spark commits them, so a lost executor costs its tasks, and a job that fails leaves nothing.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/turnweave/token_counts"
    library, raw, version = load(tokenizer or default_path())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", content_digest(F.col("text")))
    keys = written(texts.select("doc_id", "digest"), "digests")
    missing = written(keys.select("digest").distinct().join(stored(spark, cache, version), "digest", "left_anti"), "missing")
    if n := missing.count():
        few = n <= FEW
        texts = texts.join(F.broadcast(missing), "digest", "left_semi") if few else texts
        one_each = texts.groupBy("digest").agg(F.first("text").alias("text"))
        one_each = one_each if few else one_each.join(missing, "digest", "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = _loaded.get(version) or _loaded.setdefault(version, Counter(library, raw))
            for batch in batches:
                for part in slices(batch, "text"):
                    n = pa.array(count(part.column("text").to_pylist()), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("n_bytes"), n], ["digest", "n_bytes", "n_tokens"])

        found = one_each.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(encode, "digest binary, n_bytes long, n_tokens long")
        found.withColumn("tokenizer", F.lit(version)).write.mode("append").option("compression", "zstd").partitionBy("tokenizer").parquet(cache)
    joined = spread_join(keys, stored(spark, cache, version), ["digest"])
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
