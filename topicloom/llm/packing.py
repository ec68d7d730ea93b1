"""Packing by lexical retrieval.

Documents become token ids. Windows that one document fills are sequences of
their own; what is left of each document is dealt by content into shards, where
a BM25 inverted index returns unused neighbours for a seed, which fill its window
greedily. The last neighbour is cut to fit, and its rest seeds the next window.
What a shard has left in the end is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch, salted
from topicloom.llm.tokens import encoded, encoder_for

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
K1, B = 1.2, 0.75
_ONE = np.ones(1, np.int64)
_FIRST = np.ones(1, bool)
#: Of content vectors: their dimensions, how many of them a token has, how many at most shards are fitted on, and how many centres at most a level has.
DIMENSIONS, SPARSE, SAMPLE, CENTRES = 128, 8, 20_000, 1024
#: Of a sequence_id in a shard: the bits of its number there, and of the part of a crowded shard.
NUMBER_BITS, PART_BITS = 22, 20


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Of kind 0, (doc_id, n_tokens, first, ids): ids as bytes of the encoder's
    kind, with the end id; first is the number of full windows before this
    document in its task, made unique by the task's number. Of kind 1, one row a
    task: in ids, pairs of an id and of the number of its documents that hold it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        first, names = TaskContext.get().partitionId() << 40, ["doc_id", "n_tokens", "first", "ids", "kind"]
        held = np.zeros(max(encoder.mark.size, end_id + 1), np.int64)
        for rows, ids in encoded(batches, encoder, 1):
            each = [x + end for x in ids]
            n = np.array([len(x) for x in each], np.int64) // encoder.kind.itemsize
            for x in each:
                seen = np.sort(np.frombuffer(x, encoder.kind), kind="stable")
                held[seen[np.concatenate((_FIRST, seen[1:] != seen[:-1]))]] += 1
            full = n // window
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(first + np.cumsum(full) - full), pa.array(each, pa.binary()), pa.array(np.zeros(len(n), np.int32))], names=names)
            first += int(full.sum())
        used = np.flatnonzero(held)
        if len(used):
            pairs = np.column_stack((used, held[used])).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([0]), pa.array([pairs], pa.binary()), pa.array([1], pa.int32())], names=names)

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(kernel, "doc_id bigint, n_tokens bigint, first bigint, ids binary, kind int")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def full_windows(tokens: DataFrame, window: int, kind: np.dtype) -> DataFrame:
    """Pieces that fill a sequence alone."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, first, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                held = np.frombuffer(ids.as_buffer(), kind)
                rows += [(doc, k * window, window, _crc(held[k * window : (k + 1) * window]), n, first + k, 0) for k in range(n // window)]
            yield _pieces(rows)

    return tokens.where(F.col("n_tokens") >= window).mapInArrow(kernel, PIECE)


def document_frequency(counts: DataFrame) -> DataFrame:
    """(id, df) over all documents, from the tasks' pairs; as many rows as the
    vocabulary at most."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs in batch.column(0):
                t = np.frombuffer(pairs.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(t[:, 0]), pa.array(t[:, 1])], names=["id", "df"])

    return counts.select("ids").mapInArrow(kernel, "id bigint, df bigint").groupBy("id").agg(F.sum("df").alias("df"))


def _terms(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The telling terms of a rest, and how often each occurs."""
    if len(ids) == 1:
        return (ids, _ONE) if idf[ids[0]] > 0 else (ids[:0], _ONE[:0])
    ids = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.concatenate((_FIRST, ids[1:] != ids[:-1])))
    t, n = ids[at], np.diff(np.append(at, len(ids)))
    keep = idf[t] > 0
    return t[keep], n[keep]


@functools.cache
def _directions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random direction for each token id: SPARSE dimensions, and their signs."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMENSIONS, (n, SPARSE)), rng.choice(np.array([-1, 1], np.float32), (n, SPARSE))


def content_vectors(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25 weights of each rest, projected to unit vectors; zero if no term tells."""
    out = np.zeros((len(docs), DIMENSIONS), np.float32)
    where, sign = _directions(len(idf))
    for k, ids in enumerate(docs):
        t, n = _terms(ids, idf)
        weight = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ids) / mean_length))
        out[k] = np.bincount(where[t].ravel(), (sign[t] * weight.astype(np.float32)[:, None]).ravel(), DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def nearest(vectors: np.ndarray, centres: np.ndarray, price: np.ndarray) -> np.ndarray:
    return np.concatenate([(vectors[a : a + 4096] @ centres.T - price).argmax(1) for a in range(0, len(vectors), 4096)] or [np.zeros(0, np.int64)])


def fit_centres(vectors: np.ndarray, load: np.ndarray, k: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Centres of k groups, and a price of each that grows while its load is
    above the mean, so that crowded regions get more groups."""
    rng = np.random.default_rng(5)
    k = min(k, len(vectors))
    centres, price = vectors[rng.choice(len(vectors), k, replace=False)], np.zeros(k, np.float32)
    for _ in range(rounds):
        of = nearest(vectors, centres, price)
        size = np.bincount(of, load, k)
        price = np.maximum(0, price + 0.03 * np.log(np.clip(size * k / (1.3 * load.sum()), 0.25, 4))).astype(np.float32)
        order = np.argsort(of, kind="stable")
        held, at = np.unique(of[order], return_index=True)
        centres = vectors[rng.choice(len(vectors), k)]  # an empty group starts anew
        centres[held] = np.add.reduceat(vectors[order], at)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres, price


class Dealer:
    """Deals content vectors to about ``shards`` groups: by the nearest of up to
    CENTRES centres, and by the nearest of as many again, for what is left of a
    vector across its centre, as further groups need. Both levels are fitted on
    one bounded sample, and both are small whatever the corpus is."""

    def __init__(self, vectors: np.ndarray, load: np.ndarray, shards: int):
        first = min(shards, CENTRES)
        self.levels = [fit_centres(vectors, load, first)]
        if shards > first:
            rest = self._rest(vectors, nearest(vectors, *self.levels[0]))
            self.levels.append(fit_centres(rest, load, min(-(-shards // first), CENTRES)))

    def _rest(self, vectors: np.ndarray, of: np.ndarray) -> np.ndarray:
        centre = self.levels[0][0][of]
        rest = vectors - (vectors * centre).sum(1, keepdims=True) * centre
        return rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        of = nearest(vectors, *self.levels[0])
        if len(self.levels) == 1:
            return of
        return of * len(self.levels[1][1]) + nearest(self._rest(vectors, of), *self.levels[1])


def deal_by_content(tails: DataFrame, scratch: Scratch, sent, rests: int, count: int, shard_tokens: int, kind: np.dtype) -> DataFrame:
    """tails (doc_id, start, n_tokens, salt, ids) with their ``shard``, one of
    about rests / shard_tokens by content, and its ``part``: a shard whose rests
    come to more than twice shard_tokens (copies, mostly) is split by salt."""
    spark, shards = tails.sparkSession, max(1, -(-rests // shard_tokens))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in docs], pa.int64()), pa.array([x.tobytes() for x in content_vectors(docs, *sent.value)], pa.binary())], names=["load", "vector"])

    share = 0.9 * SAMPLE / count
    sample = tails if count <= SAMPLE else tails.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "n_tokens"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # the threshold bounds the sample, unless very many rows are alike; then the limit does
    rows = sorted(tuple(r) for r in sample.mapInArrow(vectors, "load bigint, vector binary").limit(SAMPLE).coalesce(1).collect()) if shards > 1 else []
    if not rows:
        rows = [(1, np.zeros(DIMENSIONS, np.float32).tobytes())]
    fitted = spark.sparkContext.broadcast(Dealer(np.stack([np.frombuffer(r[1], np.float32) for r in rows]), np.array([r[0] for r in rows], float), shards))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shards == 1:
                of = np.zeros(batch.num_rows)
            else:
                of = fitted.value(content_vectors([np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")], *sent.value))
            yield batch.append_column("shard", pa.array(of.astype(np.int32)))

    dealt = scratch.keep(tails.mapInArrow(kernel, "doc_id bigint, start bigint, n_tokens bigint, salt bigint, ids binary, shard int"), "dealt")
    loads = dealt.groupBy("shard").agg(F.sum(F.col("n_tokens") - F.col("start")).alias("load"))
    crowded = loads.where(F.col("load") > 2 * shard_tokens).select("shard", F.ceil(F.col("load") / shard_tokens).cast("int").alias("parts"))
    crowded = scratch.keep(crowded, "crowded")
    part = F.coalesce(F.pmod(F.xxhash64("salt", "doc_id"), F.col("parts")), F.lit(0)).cast("int")
    return salted(dealt, crowded, ["shard"], "salt", "left").withColumn("part", part).drop("parts")


class Index:
    """An inverted index of one shard with BM25 weights from corpus-wide
    frequencies. Terms that an eighth of the documents hold stand in full rows."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int | None = None):
        terms, tfs, owner = [], [], []
        for k, ids in enumerate(docs):
            t, n = _terms(ids, idf)
            terms.append(t)
            tfs.append(n)
            owner.append(np.full(len(t), k))
        self.terms, self.idf, self.query_terms = terms, idf, query_terms
        term, tf, doc = np.concatenate(terms), np.concatenate(tfs).astype(float), np.concatenate(owner)
        length = np.array([len(x) for x in docs], float)[doc]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.vocabulary, self.at = np.unique(term[order], return_index=True)
        self.at = np.concatenate((self.at, [len(order)]))
        self.size = len(docs)
        held = np.diff(self.at)
        full = np.flatnonzero(8 * held >= self.size)
        self.row = np.full(len(held), -1)
        self.row[full] = np.arange(len(full))
        self.rows = np.zeros((len(full), self.size))
        for k, v in enumerate(full.tolist()):
            span = slice(self.at[v], self.at[v + 1])
            self.rows[k, self.doc[span]] = self.weight[span]

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, for all terms of the seed with a positive idf, or for
        the ``query_terms`` most telling ones."""
        t = self.terms[seed]
        if self.query_terms is not None and len(t) > self.query_terms:
            t = t[np.argsort(-self.idf[t], kind="stable")[: self.query_terms]]
        where = np.searchsorted(self.vocabulary, t)
        row = self.row[where]
        common = self.rows[row[row >= 0]].sum(0)
        where = where[row < 0]
        spans = [slice(a, b) for a, b in zip(self.at[where].tolist(), self.at[where + 1].tolist(), strict=True)]
        if not spans:
            return common
        return common + np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.size)


def _nearest(scores: np.ndarray, unused: np.ndarray, most: int) -> list[int]:
    """Unused documents with a score, the highest first, then by place: at least
    the ``most`` first ones, from one partial sort."""
    hits = np.flatnonzero(unused & (scores > 0))
    if len(hits) > most:
        hits = hits[scores[hits] >= -np.partition(-scores[hits], most - 1)[most - 1]]
    return hits[np.argsort(-scores[hits], kind="stable")].tolist()


def pack_shard(shard: int, rows: list[tuple[int, int, int, bytes]], idf: np.ndarray, mean_length: float, window: int, query_terms: int | None, kind: np.dtype) -> list[tuple]:
    """Pieces of the rests (doc_id, start, doc_tokens, ids) of a shard, or of a part
    of it, by its number."""
    rows = sorted(rows, key=lambda r: (-len(r[3]), r[0] is None, r[0] or 0, r[1]))  # long seeds first
    ids = [np.frombuffer(r[3], kind) for r in rows]
    index = Index(ids, idf, mean_length, query_terms)
    unused, done = np.ones(len(rows), bool), [0] * len(rows)
    sequences: list[list[tuple[int, int, int]]] = []  # (row, from, length) each
    cursor, seed = 0, None
    while True:
        if seed is None:
            while cursor < len(rows) and not unused[cursor]:
                cursor += 1
            if cursor == len(rows):
                break
            seed = cursor
        unused[seed] = False
        room, sequence = window, []
        take = min(room, len(ids[seed]) - done[seed])
        sequence.append((seed, done[seed], take))
        done[seed] += take
        room -= take
        rest = None
        near = _nearest(index.scores(seed), unused, room) if room and len(index.terms[seed]) else []
        at = 0
        while room:
            if at < len(near):
                k, at = near[at], at + 1
            else:  # what is left shares no term with the seed, and goes by its place
                while cursor < len(rows) and not unused[cursor]:
                    cursor += 1
                if cursor == len(rows):
                    break
                k = cursor
            take = min(room, len(ids[k]))
            sequence.append((k, 0, take))
            done[k] = take
            room -= take
            unused[k] = False
            if take < len(ids[k]):
                rest = k
        sequences.append(sequence)
        seed = rest
    out, number = [], shard << NUMBER_BITS | 1 << 62
    for sequence in sequences:
        left = sum(x[2] for x in sequence)
        parts = list(reversed(sequence))
        while left:
            size = window if left == window else 1 << (left.bit_length() - 1)
            left -= size
            offset = 0
            while offset < size:
                k, a, n = parts.pop()
                take = min(n, size - offset)
                if take < n:
                    parts.append((k, a + take, n - take))
                doc, start, total, _ = rows[k]
                out.append((doc, start + a, take, _crc(ids[k][a : a + take]), total, number, offset))
                offset += take
            number += 1
    return out


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 1, window: int = 2048, shard_tokens: int = 1 << 20, query_terms: int | None = None) -> DataFrame:
    """One row (PIECE) for each piece of each document.

    Every row of ``docs`` is packed, repeated ones too; null and empty texts
    hold only the end id; ties in score go to the longer rest; an empty table
    gives an empty result; extra columns are not read. Frequencies and the mean
    length cover all documents; the frequency table has one row a vocabulary
    entry, which bounds what is broadcast. Shards hold alike rests of about
    ``shard_tokens`` tokens, and not more than twice that but by chance: crowded
    regions and copies make more shards, not larger ones. What shards are fitted on
    is bounded (SAMPLE), and so are their centres (two levels of CENTRES). A seed's neighbours are
    those of its own shard, by all its terms unless ``query_terms`` caps them; the
    README gives the share of true ones among them.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    kind = encoder_for(tokenizer).kind
    width = kind.itemsize
    both = scratch.keep(tokenized(docs, tokenizer, end_id, window), "tokens", by=("kind",))
    tokens = both.where("kind = 0")
    rest = (F.col("n_tokens") % window).cast("int")
    count, total, rests = tokens.agg(F.count("*"), F.sum("n_tokens"), F.sum(rest)).first()
    df = document_frequency(both.where("kind = 1")).collect()  # at most one row a vocabulary entry
    idf = np.zeros(max((r.id for r in df), default=0) + 1)
    for r in df:
        idf[r.id] = np.log((count - r.df + 0.5) / (r.df + 0.5))
    sent = docs.sparkSession.sparkContext.broadcast((idf, (total or 1) / max(1, count)))
    tails = tokens.where(rest > 0).select("doc_id", (F.col("n_tokens") - rest).alias("start"), "n_tokens", F.xxhash64("doc_id", "first").alias("salt"), F.expr(f"substring(ids, cast({width} * (n_tokens - n_tokens % {window}) + 1 as int), cast({width} * (n_tokens % {window}) as int))").alias("ids"))
    tails = deal_by_content(tails, scratch, sent, rests or 0, max(1, count), shard_tokens, kind).select("shard", "part", "doc_id", "start", "n_tokens", "ids")

    def kernel(table: pa.Table) -> pa.Table:
        idf, mean_length = sent.value
        rows = list(zip(*(table.column(k).to_pylist() for k in ("doc_id", "start", "n_tokens", "ids")), strict=True))
        return pa.Table.from_batches([_pieces(pack_shard(table.column("shard")[0].as_py() << PART_BITS | table.column("part")[0].as_py(), rows, idf, mean_length, window, query_terms, kind))])

    return full_windows(tokens, window, kind).union(tails.groupBy("shard", "part").applyInArrow(kernel, PIECE))
