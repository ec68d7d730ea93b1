"""Corpus sources and sinks. Readers give (doc_id, category, split, tokens)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from topicloom.functions import text as T
from topicloom.functions.rng import generator, uniform
from topicloom.sources.scratch import keep

CORPUS = "doc_id bigint, category string, split string, tokens array<string>"


def visible_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of all lines below a directory; compressed files are read
    as such, files and folders with a leading dot or underscore are skipped."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("file"), "value")


def read_labelled(spark: SparkSession, path: str, categories: Iterable[str] | None = None) -> DataFrame:
    """Lines ``doc_id category token ...`` below path/train and path/test. The
    category filter is applied in the scan, before tokens are split off."""
    parts = []
    for split in ("train", "test"):
        rows = visible_lines(spark, f"{path}/{split}").withColumn("f", F.split(F.trim("value"), r"\s+", 3)).where(F.size("f") >= 2)
        rows = rows.select(F.col("f")[0].cast("long").alias("doc_id"), F.col("f")[1].alias("category"), F.lit(split).alias("split"), F.coalesce(F.get("f", F.lit(2)), F.lit("")).alias("rest"))
        if categories is not None:
            rows = rows.where(F.col("category").isin(list(categories)))
        parts.append(rows.select("doc_id", "category", "split", T.nonempty(F.split("rest", r"\s+", -1)).alias("tokens")))
    return parts[0].union(parts[1])


def read_unlabelled(spark: SparkSession, path: str) -> DataFrame:
    """The same layout with two placeholder fields in front of the tokens; ids
    follow the sorted order of files and lines."""
    parts = []
    for split in ("train", "test"):
        rows = visible_lines(spark, f"{path}/{split}").withColumn("line", F.monotonically_increasing_id())
        parts.append(rows.select("file", "line", F.lit(split).alias("split"), F.slice(F.split(F.trim("value"), r"\s+", -1), 3, 1 << 30).alias("tokens")))
    return numbered(parts[0].union(parts[1]), ["split", "file", "line"]).select("doc_id", F.lit(None).cast("string").alias("category"), "split", "tokens")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Dense ids from 0 in the given order, without sorting into one task. The
    rows are dealt by ranges of the order, sorted within and written once with
    their place; then the sizes of the ranges, one row each, are laid before the
    places within. A second run of the ranges could draw other boundaries, so
    both sides read what was written."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = keep(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33)).withColumn("_k", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    return held.join(ahead, "_part").withColumn("doc_id", (F.col("_ahead") + F.col("_k")).cast("long")).drop("_part", "_at", "_ahead", "_k")


def running_totals(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """rows in the given order with ``ordinal`` (from 0) and ``before``, the sum of
    ``size`` over all rows ahead; null sizes count as 0. Two passes: rows are dealt by
    ranges of the order and written once with their place and running sum in the
    range; then the totals of the ranges, one row each, are laid before them."""
    at = rows.columns.index(size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = pc.fill_null(batch.column(at).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(n)
            columns = [pa.array(np.full(len(n), part, np.int64)), pa.array(np.arange(k, k + len(n))), pa.array(sums - n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_part", "_k", "_sum"])
            k, total = k + len(n), total + int(n.sum())

    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("_part", "_k", "_sum"))])
    held = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, schema), "running")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.col(size).cast("long"), F.lit(0))).alias("_t"))
    ahead = Window.orderBy("_part")  # a row a range
    sizes = sizes.select("_part", (F.sum("_n").over(ahead) - F.col("_n")).alias("_rows"), (F.sum("_t").over(ahead) - F.col("_t")).alias("_total"))
    return held.join(sizes, "_part").select(*rows.columns, (F.col("_rows") + F.col("_k")).alias("ordinal"), (F.col("_total") + F.col("_sum")).alias("before"))


def sorted_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, file, value): all visible lines below a directory, numbered by the
    order of their files' paths, then by their place in the file, wherever Spark
    splits it."""
    rows = spark.read.option("recursiveFileLookup", True).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"), "value")
    return numbered(rows, ["file", "_start", "_line"]).select(F.col("doc_id").alias("line_no"), "file", "value")


def write_corpus(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    docs.write.partitionBy("split").mode(mode).parquet(path)


def write_labelled_text(docs: DataFrame, path: str) -> None:
    """The line format that ``read_labelled`` reads, gzipped."""
    for split in ("train", "test"):
        rows = docs.where(F.col("split") == split).select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("category", F.lit("null")), F.array_join("tokens", " ")).alias("value"))
        rows.write.option("compression", "gzip").text(f"{path}/{split}")


def read_stop_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): right-trimmed lines that are not blank."""
    return spark.read.text(path).select(F.rtrim("value").alias("word")).where("word <> ''")


def read_topic_list(spark: SparkSession, path: str) -> DataFrame:
    """(topic, word, n) from lines of alternating words and counts. Lines with an
    odd number of tokens, and counts that are no integers, raise."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    rows = rows.withColumn("topic", (F.row_number().over(Window.orderBy("line")) - 1).cast("int"))  # as many rows as there are topics
    return parse_topics(rows)


def sorted_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_no, file, size) of the visible files below a directory, in the order
    of their paths: one row a file, so the order needs no data read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = files.select(F.col("path").alias("file"), F.col("length").alias("size"))
    return numbered(files, ["file"]).select(F.col("doc_id").alias("file_no"), "file", "size")


def parse_topics(rows: DataFrame) -> DataFrame:
    """(topic, value) to (topic, word, n)."""
    pairs = rows.withColumn("f", F.split(F.trim("value"), r"\s+", -1))
    pairs = pairs.withColumn("f", F.when(F.size("f") % 2 == 0, F.col("f")).otherwise(F.raise_error(F.lit("a topic has a word without a count")).cast("array<string>")))
    pairs = pairs.select("topic", "f", F.explode(F.sequence(F.lit(0), (F.size("f") / 2).cast("int") - 1)).alias("k"))
    return pairs.select("topic", F.get("f", 2 * F.col("k")).alias("word"), F.get("f", 2 * F.col("k") + 1).cast("long").alias("n"))


def read_newsgroup_tree(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(file, category, split, text) of files in category folders."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.input_file_name().alias("file"), F.col("value").alias("text")).withColumn("category", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).withColumn("split", F.lit(split))


def transform_newsgroups(posts: DataFrame, order: list[str], tokenizer: str = "nonalpha", stop: Iterable[str] = (), remove_header: bool = True, remove_walls: bool = True, lower: bool = True) -> DataFrame:
    """Posts (text, category, split, order columns) to a corpus: header lines and
    walls go, tokens are prepared, empty documents go, ids run on."""
    of = T.lines(F.col("text"))
    of = T.after_header(of) if remove_header else of
    of = T.without_walls(of) if remove_walls else of
    rows = posts.withColumn("tokens", T.prepared(F.array_join(of, "\n"), tokenizer, lower, stop)).where(F.size("tokens") > 0)
    return numbered(rows.select(*order, "category", "split", "tokens"), order).select("doc_id", "category", "split", "tokens")


def bernoulli_split(key: F.Column, train_frac: float, seed: int) -> F.Column:
    return F.when(uniform(key, F.lit(0), 0, seed) < train_frac, "train").otherwise("test")


def transform_tweets(rows: DataFrame, key: str, text: str = "text", train_frac: float = 0.6, stop: Iterable[str] = (), seed: int = 0) -> DataFrame:
    """One text a row; what stands before the first space goes (a text without a
    space stays whole); white-space tokens as they are; category 'null'."""
    body = F.expr(f"substring({text}, instr({text}, ' ') + 1)")
    out = rows.select(F.col(key).alias("doc_id"), F.lit("null").alias("category"), bernoulli_split(F.col(key), train_frac, seed).alias("split"), T.prepared(body, "whitespace", False, stop).alias("tokens"))
    return out.where(F.size("tokens") > 0)


def transform_newswire(rows: DataFrame, key: str, text: str = "text", train_frac: float = 0.8, tokenizer: str = "nonalpha", lower: bool = True, stop: Iterable[str] = (), seed: int = 0, place: str | None = None) -> DataFrame:
    """Documents <doc ...> ... </doc> in each row's text, of which the text of
    <p> paragraphs counts. ``doc_id`` is key * 2**20 + the place in the row, or, for
    rows of a document each, key * 2**32 + the column ``place``."""
    first = F.col(key) * (1 << 32) + F.col(place) if place else F.col(key) * (1 << 20)
    docs = rows.select(first.alias("_key"), F.posexplode(F.regexp_extract_all(text, F.lit(r"(?is)<doc(?:\s[^>]*)?>(.*?)</doc>"), 1)).alias("_place", "_body"))
    docs = docs.select((F.col("_key") + F.col("_place")).alias("doc_id"), T.prepared(F.array_join(T.paragraphs(F.col("_body")), "\n"), tokenizer, lower, stop).alias("tokens"))
    return docs.where(F.size("tokens") > 0).select("doc_id", F.lit("null").alias("category"), bernoulli_split(F.col("doc_id"), train_frac, seed).alias("split"), "tokens")


def read_newswire(spark: SparkSession, path: str, pattern: str = "*.gz") -> DataFrame:
    """(file_no, doc_no, text) of the newswire documents below a directory: text from
    one <doc> to the next, in the order of files and places in them.

    Files are read as what stands between ``>``, so no row holds a file, and splits
    may end anywhere. Which document a piece belongs to is the number of <doc>
    ahead of it: counted within its split as it is read, and over the splits of its
    file, one row each, afterward. Pieces come together by document alone."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", ">").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, opened = None, 0, 0
        for batch in batches:
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            opens = pc.match_substring_regex(batch.column(2), r"(?i)<doc(\s[^<]*)?$").to_pylist()
            places, docs = [], []
            for file, start, opens_one in zip(files, starts, opens, strict=True):
                if (file, start) != at:
                    at, k, opened = (file, start), 0, 0
                opened += opens_one
                places.append(k)
                docs.append(opened)
                k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(docs, pa.int64())], names=["file", "start", "value", "place", "opened"])

    pieces = keep(raw.mapInArrow(count, "file string, start bigint, value string, place bigint, opened bigint"), "pieces")
    splits = pieces.groupBy("file", "start").agg(F.max("opened").alias("n"))
    splits = splits.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("ahead"))
    files = numbered(splits.select("file").distinct(), ["file"]).select("file", F.col("doc_id").alias("file_no"))
    rows = pieces.join(splits.join(files, "file"), ["file", "start"]).withColumn("doc_no", F.col("ahead") + F.col("opened") - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "value"))), lambda x: x["value"]), ">")
    docs = rows.where("doc_no >= 0").groupBy("file_no", "doc_no").agg(text.alias("text"))
    return docs.select("file_no", "doc_no", F.concat("text", F.lit(">")).alias("text"))


def split_exact(rows: DataFrame, key: str, train_frac: float = 0.6, seed: int = 0) -> DataFrame:
    """Shuffles by hash; the first int(frac * n) rows are train, the rest test."""
    shuffled = numbered(rows.withColumn("_u", uniform(F.col(key), F.lit(1), 0, seed)), ["_u", key]).drop("_u")
    n = rows.count()
    return shuffled.withColumn("split", F.when(F.col("doc_id") < int(train_frac * n), "train").otherwise("test"))


#: sections, sentences, tokenizations and tokens of an annotated document.
ANNOTATED = "array<struct<sentences:array<struct<tokenizations:array<struct<tokens:array<struct<text:string>>>>>>>>"


def flatten_annotated(rows: DataFrame, column: str = "sections", lower: bool = False, stop: Iterable[str] = ()) -> DataFrame:
    """Token texts of nested sections, filtered like any others."""
    sentences = F.flatten(F.transform(column, lambda s: s["sentences"]))
    tokens = F.flatten(F.transform(F.flatten(F.transform(sentences, lambda s: s["tokenizations"])), lambda t: t["tokens"]))
    tokens = T.nonempty(F.transform(tokens, lambda t: t["text"]))
    return rows.withColumn("tokens", T.without(T.lowered(tokens) if lower else tokens, stop)).where(F.size("tokens") > 0).drop(column)


def annotate(docs: DataFrame) -> DataFrame:
    """The nested form of documents with ``tokens``: one section, sentence and
    tokenization."""
    token = F.transform("tokens", lambda t: F.struct(t.alias("text")))
    nested = F.array(F.struct(F.array(F.struct(F.array(F.struct(token.alias("tokens"))).alias("tokenizations"))).alias("sentences")))
    return docs.withColumn("sections", nested.cast(ANNOTATED)).drop("tokens")


def write_annotated(docs: DataFrame, path: str) -> None:
    annotate(docs).write.json(path)


def read_annotated(spark: SparkSession, path: str, **how) -> DataFrame:
    return flatten_annotated(spark.read.schema(f"doc_id bigint, category string, split string, sections {ANNOTATED}").json(path), **how).select("doc_id", "category", "split", "tokens")


def generate_corpus(spark: SparkSession, num_docs: int = 2000, num_words: int = 100, num_topics: int = 10, vocab_size: int = 100, alpha: float = 0.1, beta: float = 0.1, train_frac: float = 0.6, seed: int = 0) -> DataFrame:
    """Documents drawn from an LDA model: topics ~ Dir(beta), mixtures ~
    Dir(alpha); the category is the topic with most words (the lowest of ties).
    Every document has its own stream, so partitions don't matter."""
    phi = generator(seed, "topics").dirichlet(np.full(vocab_size, beta), num_topics)  # topics x vocabulary: parameters

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc in batch["id"].tolist():
                rng = generator(seed, "doc", doc)
                counts = rng.multinomial(num_words, rng.dirichlet(np.full(num_topics, alpha)))
                words = np.concatenate([rng.choice(vocab_size, n, p=phi[k]) for k, n in enumerate(counts)])
                rng.shuffle(words)
                rows.append((doc, str(int(counts.argmax())), "train" if rng.random() < train_frac else "test", [str(w) for w in words]))
            yield pd.DataFrame(rows, columns=["doc_id", "category", "split", "tokens"])

    return spark.range(num_docs).mapInPandas(draw, CORPUS)
