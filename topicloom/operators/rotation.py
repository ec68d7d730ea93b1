"""Collapsed Gibbs sampling for models too large to send, and for many topics.

Documents and words are dealt into as many blocks. In each of a sweep's rounds a
block of documents meets one block of words, each time another one, so a task holds
one slice of the model, and no two tasks the counts of one word. A token's topic
is drawn from all topics, or, for many of them, by Metropolis-Hastings steps whose
cost does not depend on their number.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.rng import generator

#: Rows of a sweep: a document (words, topics), a word (topics, counts), or how a block changed the topics' totals.
ROWS = "kind int, block int, id bigint, a array<int>, b array<int>"
DOCUMENT, WORD, TOTALS = 1, 0, 2
#: Bytes of a count in a slice.
CELL = 8


class Alias:
    """Draws from fixed weights, each in the same time: a topic's column holds its own
    share and that of one other topic."""

    __slots__ = ("other", "share", "weights")

    def __init__(self, weights: list[float]):
        n, total = len(weights), sum(weights)
        share, other = [x * n / total for x in weights], list(range(n))
        low, high = [k for k, x in enumerate(share) if x < 1], [k for k, x in enumerate(share) if x >= 1]
        while low and high:
            j = high.pop()
            left = share[j]
            while low:  # as long as this column fills others
                k = low.pop()
                other[k] = j
                left -= 1 - share[k]
                if left < 1:
                    low.append(j)
                    break
            else:
                high.append(j)
            share[j] = left
        for k in (*low, *high):
            share[k] = 1.0
        # a slice holds a table for each of its words: numbers are packed
        self.weights, self.share, self.other = array("d", weights), array("d", share), array("i", other)

    def draw(self, u: float) -> int:
        u *= len(self.share)
        k = int(u)
        return k if u - k < self.share[k] else self.other[k]


class Slice:
    """Counts of some words, all topics' totals, and the draws of tokens' topics.

    A document's part is sparse: topics that it holds, by its tokens. ``steps`` pairs of
    proposals are made for a token: one from the word's alias table, as the counts
    were when it was made (anew after as many draws as there are topics), one from the
    document; each is accepted by the ratio of the exact posterior to the proposal."""

    def __init__(self, num_topics: int, vocab_size: int, alpha: float, beta: float, totals: list[int], steps: int = 2):
        self.k, self.alpha, self.beta, self.vb, self.steps = num_topics, alpha, beta, vocab_size * beta, steps
        self.t = list(totals)
        self.rows: dict[int, list[int]] = {}
        self.tables: dict[int, tuple[Alias, int]] = {}

    def add(self, word: int, topics: list[int], counts: list[int]) -> None:
        row = self.rows[word] = [0] * self.k
        for z, n in zip(topics, counts, strict=True):
            row[z] = n

    def made(self, word: int) -> Alias:
        vb = self.vb
        return self.table_of(word, [t + vb for t in self.t])

    def table_of(self, word: int, below: list[float]) -> Alias:
        beta = self.beta
        return Alias([(n + beta) / x for n, x in zip(self.rows[word], below, strict=True)])

    def table(self, word: int) -> Alias:
        alias, used = self.tables.get(word, (None, self.k))
        if used >= self.k:
            alias, used = self.made(word), 0
        self.tables[word] = (alias, used + 1)
        return alias

    def dense(self, word: int, counts: dict[int, int], u: float) -> int:
        row, t, alpha, beta, vb = self.rows[word], self.t, self.alpha, self.beta, self.vb
        total, sums = 0.0, []
        for k in range(self.k):
            total += (row[k] + beta) / (t[k] + vb) * (counts.get(k, 0) + alpha)
            sums.append(total)
        u *= total
        new = 0
        while new < self.k - 1 and sums[new] <= u:
            new += 1
        return new

    def stepped(self, word: int, z: int, j: int, topics: list[int], counts: dict[int, int], draws: Iterator[float]) -> int:
        """From the topic z of the token at j, which counts leave out. The parts of z's
        posterior are kept while z stays. ``_swept`` takes the same steps for a document."""
        row, t, alpha, beta, vb, size, n = self.rows[word], self.t, self.alpha, self.beta, self.vb, self.k, len(topics) - 1
        table, used = self.tables.get(word, (None, size))
        ends, held = n + size * alpha, counts.get
        w, d = row[z] + beta, t[z] + vb
        for _ in range(self.steps):
            if used >= size:
                table, used = self.made(word), 0
            used += 1
            u = next(draws) * size
            new = int(u)
            if u - new >= table.share[new]:
                new = table.other[new]
            u = next(draws)
            if new != z:
                w_new, d_new, weights = row[new] + beta, t[new] + vb, table.weights
                if u * ((held(z, 0) + alpha) * w / d * weights[new]) < (held(new, 0) + alpha) * w_new / d_new * weights[z]:
                    z, w, d = new, w_new, d_new
            at = next(draws) * ends
            u = next(draws)
            if at < n:
                at = int(at)
                new = topics[at + (at >= j)]
            else:
                new = min(int((at - n) / alpha), size - 1)
            if new != z:
                w_new, d_new = row[new] + beta, t[new] + vb
                if u * w * d_new < w_new * d:
                    z, w, d = new, w_new, d_new
        self.tables[word] = (table, used)
        return z

    def sweep(self, words: list[int], topics: list[int], mine: list[int], rng: np.random.Generator, sparse: bool) -> None:
        """Draws the topics of a document's tokens at the places ``mine``, in order."""
        if sparse:
            self._swept(np.asarray(words), topics, np.asarray(mine, np.int64), rng)
            return
        counts: dict[int, int] = {}
        for z in topics:
            counts[z] = counts.get(z, 0) + 1
        draws = iter(rng.random(len(mine)).tolist())
        t = self.t
        for j in mine:
            word, old = words[j], topics[j]
            row = self.rows[word]
            row[old] -= 1
            t[old] -= 1
            if counts[old] == 1:
                del counts[old]
            else:
                counts[old] -= 1
            new = self.dense(word, counts, next(draws))
            topics[j] = new
            counts[new] = counts.get(new, 0) + 1
            row[new] += 1
            t[new] += 1

    def _proposed(self, mine: np.ndarray, n: int, rng: np.random.Generator) -> Iterator[tuple]:
        """What the steps of the tokens at ``mine`` propose, as far as draws alone tell:
        a column of the word's table and the place in it, a number to accept by, a
        document's proposal (a token's place, or a topic below zero, from -1 down), another number."""
        draws = rng.random(len(mine) * 4 * self.steps).reshape(-1, 4)
        column, at = draws[:, 0] * self.k, draws[:, 2] * (n + self.k * self.alpha)
        of, place = column.astype(np.int64), at.astype(np.int64)
        place += place >= np.repeat(mine, self.steps)
        topic = np.minimum(((at - n) / self.alpha).astype(np.int64), self.k - 1)
        return zip(of.tolist(), (column - of).tolist(), draws[:, 1].tolist(), np.where(at < n, place, -1 - topic).tolist(), draws[:, 3].tolist(), strict=True)

    def _swept(self, words: np.ndarray, topics: list[int], mine: np.ndarray, rng: np.random.Generator) -> None:
        """A document's steps in one loop: this is where a sweep's time goes."""
        t, rows, tables, alpha, beta, vb, size, steps = self.t, self.rows, self.tables, self.alpha, self.beta, self.vb, self.k, range(self.steps)
        counts, below, proposed = [0.0] * size, [x + vb for x in t], self._proposed(mine, len(topics) - 1, rng)
        for z in topics:
            counts[z] += 1.0
        for word, j in zip(words[mine].tolist(), mine.tolist(), strict=True):
            row, z = rows[word], topics[j]
            row[z] -= 1
            t[z] -= 1
            below[z] = t[z] + vb
            counts[z] -= 1.0
            w, d = row[z] + beta, below[z]
            table, used = tables.get(word, (None, size))
            for _ in steps:
                if used >= size:
                    table, used = self.table_of(word, below), 0
                used += 1
                new, part, u, at, v = next(proposed)
                if part >= table.share[new]:
                    new = table.other[new]
                if new != z:
                    w_new, d_new, weights = row[new] + beta, below[new], table.weights
                    if u * ((counts[z] + alpha) * w / d * weights[new]) < (counts[new] + alpha) * w_new / d_new * weights[z]:
                        z, w, d = new, w_new, d_new
                new = topics[at] if at >= 0 else -1 - at
                if new != z:
                    w_new, d_new = row[new] + beta, below[new]
                    if v * w * d_new < w_new * d:
                        z, w, d = new, w_new, d_new
            tables[word] = (table, used)
            topics[j] = z
            counts[z] += 1.0
            row[z] += 1
            t[z] += 1
            below[z] = t[z] + vb


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in ROWS.split(", ")])


def rotating_gibbs(docs: DataFrame, keep: Callable, vocab_size: int, num_topics: int, alpha: float = 0.1, beta: float = 0.1, iters: int = 20, seed: int = 0, blocks: int | None = None, slice_mb: int = 256, sparse: bool | None = None, steps: int = 2) -> DataFrame:
    """(doc_id, word_ids, topics) after ``iters`` sweeps over documents (doc_id,
    word_ids). ``keep(df, name)`` writes a table and reads it back.

    There are as many ``blocks`` as the session has cores, up to 64, or as slices of
    ``slice_mb`` the model needs, if these are more; a round has a task a block. With one block this is the
    exact chain. With more, words' counts are exact at each draw, and only the K
    totals are those of the round's start and the block's own changes; so the result
    depends on the number of blocks, but not on how Spark partitions or where tasks
    run. A sweep writes the assignments and the model ``blocks`` times. ``sparse``
    draws by Metropolis-Hastings steps; unless told, from 100 topics on."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = blocks or max(min(cores, 64), -(-CELL * vocab_size * num_topics // (slice_mb << 20)))
    sparse = num_topics >= 100 if sparse is None else sparse

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(DOCUMENT, 0, doc, words, generator(seed, "start", doc).integers(0, num_topics, len(words)).tolist()) for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    held = docs.where(F.size("word_ids") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "word_ids").mapInArrow(first, ROWS)
    held = keep(held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "rotation_docs")
    cells = held.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select(F.col("x.a").alias("word"), F.col("x.b").alias("topic")).groupBy("word", "topic").agg(F.count("*").cast("int").alias("n"))
    cells = keep(cells, "rotation_cells")
    found = {r.topic: r.n for r in cells.groupBy("topic").agg(F.sum("n").alias("n")).collect()}  # a row a topic
    totals = [found.get(k, 0) for k in range(num_topics)]
    words = cells.groupBy("word").agg(F.collect_list(F.struct("topic", "n")).alias("x"))  # at most one a topic
    words = words.select(F.lit(WORD).alias("kind"), (F.col("word") % blocks).cast("int").alias("block"), F.col("word").cast("long").alias("id"), F.col("x.topic").alias("a"), F.col("x.n").alias("b"))
    state = keep(held.select("kind", "block", "id", "a", "b").union(words), "rotation_0")

    for k in range(iters):
        for turn in range(blocks):

            def rotate(batches: Iterator[pa.RecordBatch], k: int = k, turn: int = turn, totals: list[int] = totals) -> Iterator[pa.RecordBatch]:
                place, model, out = None, None, []

                def done() -> list[tuple]:
                    word_block = (place + turn) % blocks
                    rows = [(WORD, word_block, word, [z for z, n in enumerate(row) if n], [n for n in row if n]) for word, row in model.rows.items()]
                    return [*rows, (TOTALS, place, 0, [x - y for x, y in zip(model.t, totals, strict=True)], [])]

                for batch in batches:
                    kinds, places = (batch.column(c).to_numpy() for c in ("kind", "place"))
                    ids, lists = batch.column("id").to_pylist(), [batch.column(c) for c in ("a", "b")]
                    (a, ends), (b, b_ends) = ((x.values.to_numpy(), x.offsets.to_numpy()) for x in lists)
                    drawn = np.empty(len(b), np.int32)
                    for r, (at, kind, of) in enumerate(zip(places.tolist(), kinds.tolist(), ids, strict=True)):
                        if at != place:
                            if model:
                                out += done()
                            place, model = at, Slice(num_topics, vocab_size, alpha, beta, totals, steps)
                        own, held = a[ends[r] : ends[r + 1]], b[b_ends[r] : b_ends[r + 1]].tolist()
                        if kind == WORD:
                            model.add(of, own.tolist(), held)
                            continue
                        mine = np.flatnonzero(own % blocks == (at + turn) % blocks)
                        if len(mine):
                            model.sweep(own if sparse else own.tolist(), held, mine.tolist(), generator(seed, f"rotate{k}.{turn}", of), sparse)
                        drawn[b_ends[r] : b_ends[r + 1]] = held
                    if len(documents := np.flatnonzero(kinds == DOCUMENT)):
                        first, last = int(documents[0]), int(documents[-1]) + 1
                        swept = pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("block"), batch.column("id"), lists[0], pa.ListArray.from_arrays(lists[1].offsets, pa.array(drawn))], names=["kind", "block", "id", "a", "b"])
                        yield swept.slice(first, last - first) if last - first == len(documents) else swept.take(pa.array(documents))
                if model:
                    out += done()
                for a in range(0, len(out), 1000):
                    yield _batch(out[a : a + 1000])

            place = F.when(F.col("kind") == WORD, F.pmod(F.col("block") - turn, F.lit(blocks))).otherwise(F.col("block")).cast("int")
            met = state.where(F.col("kind") != TOTALS).withColumn("place", place).repartitionById(blocks, F.col("place")).sortWithinPartitions("place", "kind", "id")
            state = keep(met.mapInArrow(rotate, ROWS), f"rotation_{k}_{turn}")
            for r in state.where(F.col("kind") == TOTALS).select("a").collect():  # K numbers a block
                totals = [x + y for x, y in zip(totals, r.a, strict=True)]
    out = state.where(F.col("kind") == DOCUMENT).select(F.col("id").alias("doc_id"), F.col("a").alias("word_ids"), F.col("b").alias("topics"))
    none = F.array().cast("array<int>")
    return out.union(docs.where(F.size("word_ids") <= 0).select(F.col("doc_id").cast("long"), none, none))


def posterior(row: list[int], totals: list[int], counts: list[int], alpha: float, beta: float, vocab_size: int) -> list[float]:
    """What a token's topic is drawn from, all counts without it."""
    p = [(n + beta) / (t + vocab_size * beta) * (c + alpha) for n, t, c in zip(row, totals, counts, strict=True)]
    total = math.fsum(p)
    return [x / total for x in p]
