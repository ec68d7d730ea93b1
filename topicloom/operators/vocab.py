"""Word counts, vocabularies, encoding, splits and samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from topicloom.functions.rng import token_hash, uniform
from topicloom.functions.text import OOV
from topicloom.sources.corpus import numbered
from topicloom.sources.scratch import keep


def long_tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept columns, pos, word): one row a token."""
    return docs.select("doc_id", *keep, F.posexplode("tokens").alias("pos", "word"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n); partial sums shrink a frequent word before it moves."""
    return docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def build_vocab(docs: DataFrame, oov_max_count: int = 1) -> DataFrame:
    """(word, word_id, n): words counted more than ``oov_max_count`` times have
    dense ids from 1 in their order, given by ranges of words, not in one task; the
    rest is one row, id 0. Counts are made and written once."""
    counts = keep(word_counts(docs), "word_counts")
    kept = numbered(counts.where(F.col("n") > oov_max_count), ["word"]).select("word", (F.col("doc_id") + 1).cast("int").alias("word_id"), "n")
    rest = counts.where(F.col("n") <= oov_max_count).agg(F.lit(OOV).alias("word"), F.lit(0).alias("word_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return rest.union(kept)


def encode_tokens(docs: DataFrame, vocab: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept, pos, word_id); unknown words have id 0. The vocabulary is
    broadcast by Spark while it is below its threshold, shuffled beyond."""
    return long_tokens(docs, *keep).join(vocab.select("word", "word_id").where("word_id > 0"), "word", "left").select("doc_id", *keep, "pos", F.coalesce("word_id", F.lit(0)).alias("word_id"))


def encode_docs(docs: DataFrame, vocab: DataFrame, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, word_ids), order kept; documents without tokens have none.

    A vocabulary of up to ``max_words`` (some 60 MB) is sent to the tasks, which
    look up whole batches without a shuffle; a larger one is joined."""
    known = vocab.where("word_id > 0")
    if known.limit(max_words + 1).count() > max_words:
        rows = encode_tokens(docs, vocab).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word_id"))).alias("w"))
        return rows.select("doc_id", F.col("w.word_id").alias("word_ids"))
    table = known.select("word", F.col("word_id").cast("int").alias("word_id")).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), table.column(1).combine_chunks()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = sent.value
        for batch in batches:
            tokens = batch.column(1)
            found = pc.index_in(tokens.flatten().cast(words.type), value_set=words)
            coded = pc.fill_null(ids.take(found), 0) if len(words) else pa.array([0] * len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(tokens.offsets if not tokens.offset else pc.subtract(tokens.offsets, tokens.offsets[0]), coded)], names=["doc_id", "word_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.size("tokens") > 0).select("doc_id", "tokens").mapInArrow(kernel, f"doc_id {kind}, word_ids array<int>")


def encode_rows(docs: DataFrame, vocab: DataFrame, max_words: int = 2_000_000) -> DataFrame:
    """docs with ``word_ids`` in place of ``tokens``, all other columns and rows as they
    are; also for streams, as nothing is shuffled. A vocabulary of more than
    ``max_words`` raises."""
    known = vocab.where("word_id > 0").select("word", F.col("word_id").cast("int").alias("word_id"))
    table = known.limit(max_words + 1).toArrow()
    if table.num_rows > max_words:
        raise ValueError("the vocabulary is too large to send")
    sent = vocab.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), table.column(1).combine_chunks()))
    at = docs.columns.index("tokens")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = sent.value
        for batch in batches:
            tokens = pc.fill_null(batch.column(at), []) if batch.column(at).null_count else batch.column(at)
            flat = tokens.flatten()
            coded = pc.fill_null(ids.take(pc.index_in(flat.cast(words.type), value_set=words)), 0) if len(words) else pa.array([0] * len(flat), pa.int32())
            offsets = pc.subtract(tokens.offsets, tokens.offsets[0])
            columns = [pa.ListArray.from_arrays(offsets, coded) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], "word_ids", *batch.schema.names[at + 1 :]])

    fields = [StructField("word_ids", ArrayType(IntegerType())) if f.name == "tokens" else f for f in docs.schema.fields]
    return docs.mapInArrow(kernel, StructType(fields))


def strip_singletons(docs: DataFrame, replacement: str | None = None) -> DataFrame:
    """Words that occur once in the corpus go, or become the replacement;
    documents left empty go. Rows of one doc_id are one document, by place.

    Documents stay whole: only the places of single words move to them, and what
    stands between these places is joined again."""
    docs = keep(docs.select("doc_id", "tokens"), "stripped").where(F.size("tokens") > 0)  # tokens are made once
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        placed = docs.select("doc_id", F.transform("tokens", lambda t, k: F.struct(k.alias("pos"), t.alias("word"))).alias("w"))
        placed = placed.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("w"))).alias("w"))
        docs = keep(placed.select("doc_id", F.col("w.word").alias("tokens")), "merged")
    # a word that is counted once has one place, which is its lowest
    once = long_tokens(docs).groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("pos").alias("pos")).where("n = 1")
    gaps = once.groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("gaps")).withColumnRenamed("doc_id", "_doc")
    rows = docs.join(gaps, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    between = F.expr("transform(gaps, (p, k) -> slice(tokens, if(k = 0, 1, gaps[k - 1] + 2), p - if(k = 0, 0, gaps[k - 1] + 1)))")
    if replacement is not None:
        between = F.transform(between, lambda x: F.concat(x, F.array(F.lit(replacement))))
    behind = F.expr("slice(tokens, gaps[size(gaps) - 1] + 2, size(tokens))")
    left = F.when(F.col("gaps").isNull(), F.col("tokens")).otherwise(F.concat(F.flatten(between), behind))
    return rows.select("doc_id", left.alias("tokens")).where(F.size("tokens") > 0)


def shuffle_key(doc: Column, seed: int) -> Column:
    return token_hash(doc, F.lit(7), 0, seed)


def take_first(docs: DataFrame, n: int | None, order: str = "doc_id") -> DataFrame:
    return docs if n is None or n < 0 else docs.orderBy(order).limit(n)


def prefix_split(docs: DataFrame, train_frac: float, order: str = "doc_id") -> DataFrame:
    """The first int(n * frac) documents are train, the rest eval. Ordinals come
    from counted ranges, not from one sorted task."""
    n = docs.count()
    key = numbered(docs.select(F.col(order).alias("_o")), ["_o"]).select(F.col("_o").alias(order), F.col("doc_id").alias("ordinal"))
    return key.withColumn("part", F.when(F.col("ordinal") < int(n * train_frac), "train").otherwise("eval"))


def kfold(docs: DataFrame, k: int, order: str = "doc_id") -> DataFrame:
    """Contiguous folds from 0; the first n % k have one document more."""
    n = docs.count()
    size, extra = divmod(n, k)
    key = numbered(docs.select(F.col(order).alias("_o")), ["_o"]).select(F.col("_o").alias(order), F.col("doc_id").alias("ordinal"))
    big = extra * (size + 1)
    fold = F.when(F.col("ordinal") < big, F.floor(F.col("ordinal") / (size + 1))).otherwise(extra + F.floor((F.col("ordinal") - big) / max(size, 1)))
    return key.withColumn("fold", fold.cast("int"))


def sample_without_replacement(docs: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """n rows by hashed priority (all, if there are fewer): what a reservoir
    holds at the end of a stream. A small n is a top-n without a full sort; a
    large one is cut off from counted ranges, so no task holds n rows."""
    rows = docs.withColumn("priority", uniform(F.col(key), F.lit(3), 0, seed))
    if n <= 100_000:
        return rows.orderBy("priority", key).limit(n)
    if n >= docs.count():
        return rows
    order = numbered(rows.select("priority", F.col(key).alias("_k")), ["priority", "_k"]).where(F.col("doc_id") < n).select(F.col("_k").alias(key))
    return rows.join(order, key, "left_semi")
