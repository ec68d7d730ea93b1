"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses where chunks end,
so an inserted line moves only the chunks beside it. Chunks of several lines
that occur more than once anywhere keep their first occurrence; a repeat counts
only if its bytes are equal.

A repeated passage may begin or end within a chunk, or hold no whole one. What
boundaries cut off so is found by its runs of lines: from each line on, and up
to each line, outside the chunks that are already gone, the shortest run that is
long enough is keyed. Any repeated run is covered by those runs within it, so
what goes does not depend on where chunks end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import Scratch, characters_before, chunks, row_keys, span_hash

WINDOW, DIVISOR, MIN_LINES, MIN_CHARS = 2, 3, 2, 80


def _with_chunks(docs: DataFrame, window: int, divisor: int) -> DataFrame:
    """Adds __l_lines and __l_ends, the numbers of the lines that end a chunk."""
    lined = docs.withColumn("__l_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    hashed = lined.withColumn("__l_hash", F.transform("__l_lines", lambda x: F.xxhash64(x)))
    last = F.size("__l_lines") - 1

    def ends(i):
        rolled = F.xxhash64(*[F.get("__l_hash", i - j) for j in range(window)])
        return (i == last) | ((i >= window - 1) & (F.pmod(rolled, F.lit(divisor)) == 0))

    return hashed.withColumn("__l_ends", F.filter(F.sequence(F.lit(0), last), ends)).drop("__l_hash")


def _chunk(k):
    """Line number and count of chunk k, whose last line stands in __l_ends."""
    begin = F.coalesce(F.get("__l_ends", k - 1) + 1, F.lit(0))
    return begin, F.get("__l_ends", k) - begin + 1


def _numbers():
    return F.sequence(F.lit(0), F.size("__l_ends") - 1)


def line_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, with_text: bool = False) -> DataFrame:
    """Chunks that may be removed: (doc_id, k, b, n, h1, h2[, chunk]), with their
    number, first line and number of lines."""

    def build(k):
        begin, n = _chunk(k)
        return F.struct(k.alias("k"), begin.alias("b"), n.alias("n"), F.array_join(F.slice("__l_lines", begin + 1, n), "\n").alias("chunk"))

    rows = _with_chunks(docs.select("doc_id", "text"), window, divisor).select("doc_id", F.explode(F.transform(_numbers(), build)).alias("c"))
    rows = rows.select("doc_id", "c.k", "c.b", "c.n", "c.chunk").where((F.col("n") >= min_lines) & (F.length("chunk") >= min_chars))
    return rows.select("doc_id", "k", "b", "n", *_pair("chunk"), *(["chunk"] if with_text else []))


def _pair(column: str) -> list[F.Column]:
    """128 bits of a text."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(17), F.col(column), F.length(column)).alias("h2")]


def _later(spots: DataFrame, texts: Callable[[DataFrame], DataFrame], place: F.Column, scratch: Scratch, name: str) -> DataFrame:
    """Of spots (h1, h2, ...), those equal in bytes to an earlier one by ``place``.
    ``texts(asked)`` gives spots of the asked (h1, h2) with their bytes as ``own``.
    Unequal bytes of one hash are told apart; map tasks keep one row of equal ones.
    Joins are of one kind at every size, so what moves grows with the input."""
    keys = ["h1", "h2"]
    again = scratch.keep(spots.groupBy(*keys).agg(F.count("*").alias("held")).where("held > 1").select(*keys), f"{name}_again")
    kinds = texts(again).groupBy(*keys, "own").agg(F.min(place).alias("first"), F.count("*").alias("held"))
    kinds = scratch.keep(kinds, f"{name}_kinds")
    by_hash = kinds.groupBy(*keys).agg(F.count("*").alias("kinds"), F.min("first").alias("first"), F.max("held").alias("held"))
    by_hash = scratch.keep(by_hash, f"{name}_hashes")
    one = by_hash.where("kinds = 1 and held > 1").select(*keys, "first")
    out = spots.join(one.hint("merge"), keys).where(place > F.col("first")).drop("first", *keys)
    if (mixed := by_hash.where("kinds > 1").select(*keys)).limit(1).count():  # unequal bytes of one hash
        out = out.union(texts(mixed).join(kinds.where("held > 1").select(*keys, "own", "first"), [*keys, "own"]).where(place > F.col("first")).select(*out.columns))
    return out


def repeated_chunks(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """(doc_id, k, b, n) of every chunk that is equal in bytes to an earlier one,
    by (doc_id, k), of documents with unique ids."""
    spots = scratch.keep(line_chunks(docs, **how), "spots")

    def texts(asked: DataFrame) -> DataFrame:
        return line_chunks(docs, with_text=True, **how).withColumnRenamed("chunk", "own").join(asked.hint("merge"), ["h1", "h2"], "left_semi")

    return _later(spots, texts, F.struct("doc_id", "k"), scratch, "chunks")


def shortest_runs(raw: np.ndarray, at: np.ndarray, min_lines: int, min_chars: int) -> tuple[np.ndarray, ...]:
    """(document, first line, lines, start, end) of the shortest runs of at least
    min_lines lines and min_chars characters from each line on and up to each
    line. Lines count from 0 in each document, start and end are in bytes."""
    n_docs = len(at) - 1
    breaks = np.flatnonzero(raw == 10)
    holder = np.searchsorted(at, breaks, "right") - 1
    docs = np.arange(n_docs)
    start, owner = np.concatenate((at[:-1], breaks + 1)), np.concatenate((docs, holder))
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.concatenate((breaks, at[1:]))
    end = end[np.lexsort((end, np.concatenate((holder, docs))))]
    first = np.searchsorted(owner, np.arange(n_docs + 1))
    begins, ends, line = characters_before(raw, start), characters_before(raw, end), np.arange(len(start))
    last = np.maximum(line + min_lines - 1, np.searchsorted(ends, begins + min_chars, "left"))
    onward = last < first[owner + 1]
    head = np.minimum(line - min_lines + 1, np.searchsorted(begins, ends - min_chars, "right") - 1)
    upto = head >= first[owner]
    pairs = np.unique(np.concatenate((line[onward] * len(line) + last[onward], head[upto] * len(line) + line[upto])))
    a, b = pairs // len(line), pairs % len(line)
    return owner[a], a - first[owner[a]], b - a + 1, start[a], end[b]


def repeated_runs(docs: DataFrame, gone: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, b, n) of runs of lines that are equal in bytes to an earlier one,
    of documents with unique ids. Runs within one of the chunks ``gone`` (doc_id,
    cut: [(b, n)]) are left out: their first occurrence stands elsewhere."""
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("b", "n", "h1", "h2"))])
    keyed = docs.select("doc_id", F.col("text").alias("_text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches, "_text"):
            doc, b, n, start, end = shortest_runs(raw, at, min_lines, min_chars)
            first = np.searchsorted(np.flatnonzero(raw == 10), at) + np.arange(len(at))  # of each document, among all lines of the block
            chunk = np.full(first[-1], -1)
            for k, cut in enumerate(rows.column(2).to_pylist()):
                for j, x in enumerate(cut or ()):
                    chunk[first[k] + x["b"] : first[k] + x["b"] + x["n"]] = j
            head, last = chunk[first[doc] + b], chunk[first[doc] + b + n - 1]
            use = (head < 0) | (head != last)
            doc, b, n, start, end = (x[use] for x in (doc, b, n, start, end))
            hashes = [span_hash(raw, start, end, k).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), *map(pa.array, (b, n, *hashes))], names=kind.names)

    # one kind of join at every size: texts move once
    left = keyed.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "_text", "cut")
    spots = scratch.keep(left.mapInArrow(kernel, kind), "runs")

    def texts(asked: DataFrame) -> DataFrame:
        """Only texts that hold an asked run move, and of those only such runs."""
        wanted = spots.join(asked.hint("merge"), ["h1", "h2"], "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("b", "n", "h1", "h2")).alias("asked"))
        held = keyed.join(wanted.hint("merge"), "doc_id").withColumn("lines", F.split("_text", "\n", -1))
        cut = F.transform("asked", lambda x: F.struct(x["b"].alias("b"), x["n"].alias("n"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.array_join(F.slice("lines", (x["b"] + 1).cast("int"), x["n"].cast("int")), "\n").alias("own")))
        return held.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")

    return _later(spots, texts, F.struct("doc_id", "b"), scratch, "runs")


def dedup_passages(docs: DataFrame, scratch: Scratch, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without any line that lies in a run of min_lines lines and
    min_chars characters or more which occurs before, by (doc_id, place), and the
    columns n_lines, n_chunks, removed_chunks (those that lost all their lines)
    and removed_lines.

    Repeated chunks go first, then the runs that chunk ends cut off. Each row is a
    document: rows that repeat a doc_id go by the hash of their texts, rows
    without one come after all others. Null texts stay null, with no lines; a
    document that loses all its lines stays with an empty text; an empty table
    gives an empty result. Columns of docs with the added names are replaced.
    """
    added = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    names = [c for c in docs.columns if c not in added]
    rows, _ = row_keys(docs.select(*names), scratch)
    whole = rows.select(F.col("__row").alias("doc_id"), "text")
    again = scratch.keep(repeated_chunks(whole, scratch, window=window, divisor=divisor, min_lines=min_lines, min_chars=min_chars), "chunks_gone")
    cut = scratch.keep(again.groupBy("doc_id").agg(F.collect_list(F.struct("b", "n")).alias("cut")), "cut")
    runs = repeated_runs(whole, cut, scratch, min_lines, min_chars)
    ranges = again.select("doc_id", F.col("b").cast("long").alias("b"), F.col("n").cast("long").alias("n")).union(runs.select("doc_id", "b", "n"))
    number = F.explode(F.sequence(F.col("b").cast("int"), (F.col("b") + F.col("n") - 1).cast("int")))
    gone = scratch.keep(ranges.select(F.col("doc_id").alias("__l_row"), number.alias("line")).groupBy("__l_row").agg(F.collect_set("line").alias("__l_gone")), "lines_gone")
    scratch.drop("spots", "runs", "cut", "chunks_gone", *(f"{x}_{y}" for x in ("chunks", "runs") for y in ("again", "kinds", "hashes")))
    rows = rows.join(gone.hint("merge"), F.col("__row") == F.col("__l_row"), "left").drop("__l_row", "__row")
    cut = _with_chunks(rows, window, divisor)
    of_line = F.flatten(F.transform(_numbers(), lambda k: F.array_repeat(k, _chunk(k)[1])))
    cut = cut.withColumn("__l_left", F.when(F.col("__l_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__l_lines") - 1), "__l_gone"))).withColumn("__l_of_line", F.when(F.col("__l_gone").isNotNull(), of_line))
    empty, whole = F.col("text").isNull(), F.col("__l_gone").isNull()
    kept = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform("__l_left", lambda i: F.get("__l_lines", i)), "\n"))
    chunks_left = F.size(F.array_distinct(F.transform("__l_left", lambda i: F.get("__l_of_line", i))))
    return cut.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in names],
        F.when(empty, 0).otherwise(F.size("__l_lines")).cast("long").alias("n_lines"),
        F.when(empty, 0).otherwise(F.size("__l_ends")).cast("long").alias("n_chunks"),
        F.when(whole, 0).otherwise(F.size("__l_ends") - chunks_left).cast("long").alias("removed_chunks"),
        F.when(whole, 0).otherwise(F.size("__l_gone")).cast("long").alias("removed_lines"),
    )
