"""Token counts through a cache keyed by content and tokenizer digests.

Only texts that the cache doesn't hold for this tokenizer are encoded, each
once however many copies there are, and their counts are appended. The cache
is a Parquet folder in shared storage, so a lost executor loses nothing of it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.session import scratch_path, stage

CACHE = "tokenizer string, digest string, n_bytes bigint, n_tokens bigint"
ENCODE_CHARS = 256 << 10
BROADCAST_ROWS = 50_000  # of at most 120 bytes
FEW = 0.1  # share of the documents up to which a warm cache is taken to hold nearly all


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: its library and the bytes of its vocabulary."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    module = __import__(kind)
    with open(path, "rb") as f:
        return hashlib.sha256(f"{kind} {module.__version__} ".encode() + f.read()).hexdigest()


@functools.lru_cache(maxsize=4)
def _counter(path: str):
    """Texts to token counts. The file must stand at the same path on every executor, as an installed package does."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            counts, some, held = [], [], 0
            for text in batch.column("_text"):
                some.append(text.as_py())
                held += len(some[-1])
                if held >= ENCODE_CHARS:
                    counts += count(some)
                    some, held = [], 0
            counts += count(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column("_digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def _read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts of this tokenizer, one row per digest even if two jobs appended the same."""
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE)
    return found.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing_texts(docs: DataFrame, missing: DataFrame, few: bool, id_col: str, text: str) -> DataFrame:
    """Digest and text of the misses, each named by one document that holds it.

    Few misses travel to the texts, which then stay where they are read; else
    texts and misses meet by id, which also deals out the encoding evenly.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = texts.join(missing.hint("broadcast" if few else "shuffle_hash"), texts["_id"].eqNullSafe(missing["_id"]))
    # an id on several rows may meet the digest of another text
    return joined.filter(F.sha2("_text", 256) == F.col("_digest")).select("_digest", "_text")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens and over_limit.

    ``cache`` is the folder of earlier counts; None starts an empty one. Null
    texts count as empty, which is the only normalisation, since any other
    could change a count. Special strings inside a text are what the library
    takes them for; no begin, end or added tokens count, and nothing is cut.
    Each row gets its row, repeated ones and null ids too.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache = cache or scratch_path(spark, "token-cache")
    body = F.coalesce(F.col(text), F.lit(""))
    # one narrow row per document; texts themselves move only for the misses, and not at all if these are few
    keyed = stage(docs.select(F.col(id_col).alias("_id"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).cast("long").alias("n_bytes")), "token-digests")
    known = _read_cache(spark, cache, version)
    missing = keyed.join(known, keyed["_digest"] == known["digest"], "left_anti").groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull(), "_id")).alias("_first"), F.first("n_bytes").alias("_bytes"))
    missing = stage(missing.select("_digest", "_bytes", F.col("_first._id").alias("_id")), "token-misses")
    n_missing = missing.count()
    if n_missing:
        few = n_missing <= BROADCAST_ROWS and n_missing <= FEW * keyed.count()
        chosen = missing_texts(docs, missing, few, id_col, text)
        counted = chosen.mapInArrow(_encode(tokenizer), "digest string, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        sized = counted.join(missing.select(F.col("_digest").alias("digest"), F.col("_bytes").alias("n_bytes")), "digest")
        sized.select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache)
    stored = _read_cache(spark, cache, version)
    out = keyed.join(stored, keyed["_digest"] == stored["digest"])
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
