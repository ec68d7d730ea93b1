"""Merkle manifest of a data set: a node store in level-partitioned Parquet.

Leaves of each language form a binary tree, and the languages' roots another one.
Sorted runs of 2**HEIGHT nodes stream through tasks; each level of a run is made
from the one below and written, and the tops of the runs are the lowest level of
the next tier. Proofs come from merge-scans: stored levels, what lies above the
run, and the leaves arrive together in the order of their coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch, runs
from topicloom.sources.corpus import numbered

#: Levels that a task makes from one run of nodes.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree bigint, first bigint, n bigint, nodes binary, level int"
MERGED = "tree bigint, run bigint, kind int, place bigint, first bigint, n bigint, held binary, id bigint"
PATHS = "tree bigint, idx bigint, path binary"
PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: A step of a path: no sibling, one to the left, or one to the right.
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    """Digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def parent(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _hexed(nodes: bytes) -> list[str]:
    text = nodes.hex()
    return [text[a : a + 64] for a in range(0, len(text), 64)]


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


class Store:
    """The levels of a forest, by tier: ``tiers[t]`` has levels t * HEIGHT to
    (t + 1) * HEIGHT, one row (tree, first, n, nodes, level) a run and level, where n
    is the number of the tree's nodes on that level. The last level of a tier is
    the first of the next. ``height`` levels are made of a run in memory."""

    def __init__(self, scratch: Scratch, name: str, base: DataFrame, most: int, height: int = HEIGHT):
        """base: (tree, idx, n, hash); most: nodes of the largest tree."""
        self.scratch, self.name, self.height, self.tiers = scratch, name, height, []
        while True:
            t = len(self.tiers)
            rows = base.select("tree", F.shiftright("idx", height).alias("run"), "idx", "n", "hash").repartition("tree", "run").sortWithinPartitions("tree", "run", "idx")
            self.tiers.append(scratch.keep(rows.mapInArrow(lambda batches, t=t: _grown(batches, t, height), NODES), f"{name}_tier_{t}", ("level",)))
            most = -(-most >> height)
            if most <= 1:
                return
            base = self.tiers[t].where((F.col("level") == (t + 1) * height) & (F.col("n") > 1)).select("tree", F.col("first").alias("idx"), "n", F.col("nodes").alias("hash"))

    def roots(self) -> DataFrame:
        """(tree, root)."""
        every = self.tiers[0]
        for tier in self.tiers[1:]:
            every = every.union(tier)
        return every.where("n = 1").select("tree", F.col("nodes").alias("root"))

    def scan(self, t: int, upper: DataFrame | None) -> DataFrame:
        """MERGED rows of tier t: for each run of nodes first the path above it
        (tree, idx of the run, path), then its levels."""
        k = F.col("level") - t * self.height
        levels = self.tiers[t].where((k < self.height) | (F.col("n") == 1))
        run = F.expr(f"shiftright(first, {self.height} - (level - {t * self.height}))")
        none = F.lit(None).cast("long")
        rows = levels.select("tree", run.alias("run"), F.lit(1).alias("kind"), k.cast("long").alias("place"), "first", "n", F.col("nodes").alias("held"), none.alias("id"))
        if upper is not None:
            rows = rows.union(upper.select("tree", F.col("idx").alias("run"), F.lit(0), F.lit(0).cast("long"), none, none, "path", none))
        return rows

    def paths(self, t: int = 0) -> DataFrame:
        """(tree, idx, path): what each node on the lowest level of a tier meets on
        its way up to the root of its tree."""
        if t == len(self.tiers):
            return self.tiers[0].sparkSession.createDataFrame([], PATHS)
        rows = self.scan(t, self.paths(t + 1) if t + 1 < len(self.tiers) else None)
        height = self.height
        return self.scratch.keep(merged(rows).mapInArrow(lambda batches: _climbed(batches, height), PATHS), f"{self.name}_paths_{t}")


def merged(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "kind", "place")


def _grown(batches: Iterator[pa.RecordBatch], t: int, height: int) -> Iterator[pa.RecordBatch]:
    """The levels of each run, each made from the one below."""
    for rows in runs(batches, 2):
        tree, run, n = (rows.column(k)[0].as_py() for k in (0, 1, 3))
        nodes = [x.hex() for x in rows.column(4).to_pylist()]
        out: list[tuple] = []
        for up in range(height + 1):
            out.append((tree, run << height >> up, n, bytes.fromhex("".join(nodes)), t * height + up))
            if n == 1:
                break
            nodes, n = [parent(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], (n + 1) // 2
        yield _batch(NODES, **dict(zip(("tree", "first", "n", "nodes", "level"), map(list, zip(*out, strict=True)), strict=True)))


def _levels(rows: pa.RecordBatch) -> tuple[bytes, list[list[str]], int]:
    """What lies above a run, its levels, and how many of its rows these take."""
    kinds = rows.column(2).to_numpy(zero_copy_only=False)
    n_upper, n_known = int((kinds == 0).sum()), int((kinds <= 1).sum())
    held = rows.column(6).slice(0, n_known).to_pylist()
    n = rows.column(5).slice(n_upper, n_known - n_upper).to_pylist()
    levels = [_hexed(x) for x, many in zip(held[n_upper:], n, strict=True) if many > 1]
    return held[0] if n_upper else b"", levels, n_known


def _way(levels: list[list[str]], k: int) -> list[tuple[bytes, str]]:
    """Steps of the k-th node of a run up to its top."""
    out = []
    for nodes in levels:
        beside = k ^ 1
        out.append((LEFT if beside < k else RIGHT, nodes[beside]) if beside < len(nodes) else (ALONE, ""))
        k >>= 1
    return out


def _packed(way: list[tuple[bytes, str]]) -> bytes:
    return b"".join(side + bytes.fromhex(node) for side, node in way)


def _unpacked(path: bytes) -> list[tuple[bytes, str]]:
    out, at = [], 0
    while at < len(path):
        side = path[at : at + 1]
        size = 0 if side == ALONE else 32
        out.append((side, path[at + 1 : at + 1 + size].hex()))
        at += 1 + size
    return out


def folded(node: str, way: list[tuple[bytes, str]]) -> str:
    """The root that a node leads to."""
    for side, beside in way:
        node = parent(node) if side == ALONE else parent(beside, node) if side == LEFT else parent(node, beside)
    return node


def _climbed(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, 2):
        tree, run = rows.column(0)[0].as_py(), rows.column(1)[0].as_py()
        above, levels, _ = _levels(rows)
        n = max(1, len(levels[0]) if levels else 1)
        yield _batch(PATHS, tree=[tree] * n, idx=[(run << height) + k for k in range(n)], path=[_packed(_way(levels, k)) + above for k in range(n)])


def _proven(batches: Iterator[pa.RecordBatch], root: str, height: int) -> Iterator[pa.RecordBatch]:
    """Proofs of each run's leaves, which come behind its levels. A leaf's row has
    its place, its id, its hash and, where it was tampered with, the other hash.
    The path above a run holds the subroot in its first 32 bytes."""
    for rows in runs(batches, 2):
        above, levels, known = _levels(rows)
        subroot, upper = above[:32].hex(), _unpacked(above[32:])
        upper_nodes, ends = "".join(x for _, x in upper), {}
        leaves = rows.slice(known)
        out: dict[str, list] = {name.split()[0]: [] for name in PROVEN.split(", ")}
        for doc, place, held in zip(leaves.column(7).to_pylist(), leaves.column(3).to_pylist(), leaves.column(6).to_pylist(), strict=True):
            leaf, claimed = held[:32].hex(), held[-32:].hex()
            way = _way(levels, place & ((1 << height) - 1))
            top = folded(claimed, way)
            if top not in ends:
                ends[top] = folded(top, upper)
            for name, x in zip(out, (doc, leaf, subroot, root, parent(*(x for _, x in way), upper_nodes), ends[top], ends[top] == root), strict=True):
                out[name].append(x)
        yield _batch(PROVEN, **out)


def proofs(docs: DataFrame, scratch: Scratch, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """PROVEN rows, one a row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``tampered`` says whose n_chars is claimed to be one more; proofs and roots are
    of the rows as they are. Leaves of a language go by doc_id, null ids first and
    equal ids by their hashes, so repeated rows are leaves of their own. A null
    language is one language, the first. Null fields are hashed as such, and a null
    n_chars can't be tampered with. A row alone is its own root, its proof the hash of
    nothing. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    names = [F.col(c) for c in FIELDS]
    more = [(F.col(c).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == "n_chars" else F.col(c) for c in FIELDS]
    changed = F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", leaf_hash(names).alias("leaf"), F.when(changed, leaf_hash(more)).alias("claimed"))
    leaves = scratch.keep(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = numbered(leaves, ["lang", "id", "leaf", "row"]).withColumnRenamed("doc_id", "at")
    placed = scratch.keep(placed.drop("row"), "placed")
    langs = scratch.keep(placed.groupBy("lang").agg(F.min("at").alias("tree"), F.count("*").alias("n")), "langs")
    known = langs.withColumnRenamed("lang", "theirs")
    rows = placed.join(known, F.col("lang").eqNullSafe(F.col("theirs"))).select("tree", (F.col("at") - F.col("tree")).alias("idx"), "n", "id", "leaf", "claimed")
    rows = scratch.keep(rows, "rows")
    most, many = langs.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    forest = Store(scratch, "forest", rows.select("tree", "idx", "n", F.col("leaf").alias("hash")), most, height)
    subroots = scratch.keep(numbered(forest.roots(), ["tree"]).select("tree", F.col("doc_id").alias("idx"), "root"), "subroots")
    crown = Store(scratch, "crown", subroots.select(F.lit(0).cast("long").alias("tree"), "idx", F.lit(many).cast("long").alias("n"), F.col("root").alias("hash")), many, height)
    found = crown.roots().first()  # one row
    root = found.root.hex() if found else ""
    # above each run: its tree's subroot, then the path from the run's top to the subroot and on to the root
    crowned = subroots.join(crown.paths().select("idx", F.col("path").alias("last")), "idx").select("tree", "root", "last")
    above = forest.tiers[0].where("level = 0").select("tree", F.shiftright("first", height).alias("idx"))
    if len(forest.tiers) > 1:
        above = above.join(forest.paths(1), ["tree", "idx"], "left")
    else:
        above = above.withColumn("path", F.lit(None).cast("binary"))
    above = above.join(crowned, "tree").select("tree", "idx", F.concat("root", F.coalesce("path", F.lit(b"")), "last").alias("path"))
    none = F.lit(None).cast("long")
    ends = rows.select("tree", F.shiftright("idx", height), F.lit(2), "idx", none, none, F.concat("leaf", F.coalesce("claimed", F.lit(b""))), "id")
    return merged(forest.scan(0, above).union(ends)).mapInArrow(lambda batches: _proven(batches, root, height), PROVEN)


def merkle_manifest(docs: DataFrame, scratch: Scratch, height: int = HEIGHT) -> DataFrame:
    """``proofs`` where every row is claimed as it is, but for those whose id's
    decimal digits have an unsigned crc32 that 7 divides."""
    return proofs(docs, scratch, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, height)
