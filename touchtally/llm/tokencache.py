"""Token counts through a digest cache.

A text is named by the digest of its normalised content, a tokenizer by the digest of its
file, library, library version and options. Stored counts are joined by both; only distinct
digests without one are encoded, each once, and their counts are appended to the cache.

The cache is a Parquet folder in a shared place, ``tokenizer=<digest>/`` for each tokenizer, so a
run reads its own tokenizer's counts only. An append is a copy of a written table; two runs at
once may both append a digest, and reading takes one row of each. Texts are read once for the digests
and once more for what is missing. Few missing digests are broadcast to the second reading; many meet
the texts by a shuffle, copies combined before it. What is joined back to documents is digests and counts.

Normalisation must keep the token count, so it only makes null texts empty: these tokenizers see every character.

Cases: null and empty texts have the empty text's digest and no tokens; rows with one doc_id, or none, are
counted each for itself; repeated rows give repeated results; an empty table gives no row and appends nothing;
long texts are encoded whole, one at a time. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchtally.llm.common import row_slices, string_buffer, written
from touchtally.sources.checkpoints import broadcast_if_small

# A digest and a count are about 50 bytes.
MAX_BROADCAST_DIGESTS = 100_000
TOKEN_LIMIT = 4096


@lru_cache(maxsize=2)
def _encoder(kind: str, model: bytes) -> Callable[[list[str]], list[int]]:
    if kind == "sentencepiece":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@dataclass(frozen=True)
class TokenizerVersion:
    """A tokenizer file's content with the library that reads it."""

    kind: str
    model: bytes
    digest: str

    @classmethod
    def load(cls, path: str) -> TokenizerVersion:
        """``.model`` files are for sentencepiece, ``.json`` files for tokenizers."""
        kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        if kind == "sentencepiece":
            import sentencepiece as library
        else:
            import tokenizers as library
        with open(path, "rb") as file:
            model = file.read()
        options = f"{kind} {library.__version__} no-special-tokens no-truncation"
        return cls(kind, model, hashlib.sha256(options.encode() + b"\0" + hashlib.sha256(model).digest()).hexdigest())

    def count(self, texts: list[str]) -> list[int]:
        return _encoder(self.kind, self.model)(texts)


def normalised(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def content_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def stored_counts(spark: SparkSession, cache: str, version: TokenizerVersion) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer, once per digest; None if it has no counts yet."""
    folder = f"{cache}/tokenizer={version.digest}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(texts: DataFrame, version: TokenizerVersion) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = string_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets):
                counts = version.count(batch.column("text").slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(lo, hi - lo), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, version: TokenizerVersion, cache: str) -> DataFrame:
    """doc_id, digest, n_bytes, n_tokens and ``cached`` (the count was stored before this run) per row; fills ``cache``."""
    texts = docs.select(normalised().alias("text")).withColumn("digest", content_digest())
    keyed = written(docs.select("doc_id", content_digest().alias("digest"), F.octet_length(normalised()).cast("long").alias("n_bytes")), "tokens-keyed")
    wanted, stored = keyed.select("digest").distinct(), stored_counts(docs.sparkSession, cache, version)
    found = wanted.withColumn("n_tokens", F.lit(None).cast("long")) if stored is None else wanted.join(stored, "digest", "left")
    found = written(found, "tokens-found")
    missing, known = found.filter("n_tokens IS NULL").select("digest"), found.filter("n_tokens IS NOT NULL")
    few = missing.limit(MAX_BROADCAST_DIGESTS + 1).count() <= MAX_BROADCAST_DIGESTS
    if few:
        once = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
    else:
        once = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
    fresh = written(_encode(once, version), "tokens-fresh")
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(f"{cache}/tokenizer={version.digest}")
    counts = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return keyed.join(broadcast_if_small(counts, MAX_BROADCAST_DIGESTS), "digest").select("doc_id", "digest", "n_bytes", "n_tokens", "cached")
