"""Uniform samples of bounded size for every key of the data.

Each row has a priority hashed from its id; a key's sample is its rows of lowest
priority. So samples don't depend on the order of rows, those of parts merge into
that of the whole, and batch and stream give the same ones.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from topicloom.functions.rng import token_hash

#: Up to this many rows a key, Spark limits groups before it moves rows.
GROUP_LIMIT = 1000
CUTS = 1024
CHANGES = "lane int, id bigint, priority bigint, entered boolean"


def priority(of: F.Column, seed: int) -> F.Column:
    return token_hash(of, F.lit(3), 0, seed)


def reservoir_by_key(rows: DataFrame, key: str, n: int, of: str = "doc_id", seed: int = 0) -> DataFrame:
    """For each value of ``key`` (null is one) the n rows of lowest priority, with it.

    A large n is first cut off by counts of the key's priorities in CUTS ranges, so
    no more than the ranges that hold the first n rows are sorted."""
    rows = rows.withColumn("priority", priority(F.col(of), seed))
    if n > GROUP_LIMIT:
        cut = F.floor(F.col("priority") * CUTS / (1 << 31)).cast("int")
        counts = rows.groupBy(F.col(key).alias("_key"), cut.alias("_cut")).agg(F.count("*").alias("_n"))
        ahead = F.sum("_n").over(Window.partitionBy("_key").orderBy("_cut")) - F.col("_n")  # CUTS rows a key
        last = counts.withColumn("_ahead", ahead).where(F.col("_ahead") < n).groupBy("_key").agg(F.max("_cut").alias("_last"))
        rows = rows.join(last, F.col(key).eqNullSafe(F.col("_key"))).where(cut <= F.col("_last")).drop("_key", "_last")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("priority", of))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


class ReservoirProcessor(StatefulProcessor):
    """The n rows of lowest priority of one key and lane. One value holds their
    priorities and ids in order; each row is a value of its own. A full reservoir
    skips a row by its priority alone, without reading any other."""

    def __init__(self, n: int, key: str):
        self.n, self.key = n, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = StructType([StructField("bytes", BinaryType())])
        self.order = handle.getValueState("order", held)
        self.rows = handle.getMapState("rows", StructType([StructField("priority", LongType()), StructField("id", LongType())]), held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order: list[tuple[int, int]] = pickle.loads(bytes(self.order.get()[0])) if self.order.exists() else []
        before, fresh = set(order), {}
        for batch in rows:
            if len(order) >= self.n:
                batch = batch[batch["priority"] <= (order[-1][0] if order else -1)]
            for r in batch.sort_values(["priority", "id"]).itertuples(index=False):
                at = (int(r.priority), int(r.id))
                if len(order) >= self.n and (not order or at >= order[-1]):
                    break  # so are all behind it
                place = bisect.bisect_left(order, at)
                if place < len(order) and order[place] == at:
                    continue  # a row that is there
                order.insert(place, at)
                fresh[at] = bytes(r.payload)
                if len(order) > self.n:
                    fresh.pop(order.pop(), None)
        after = set(order)
        for at in before - after:
            self.rows.removeKey(at)
        for at in after - before:
            self.rows.updateValue(at, (fresh[at],))
        if after != before:
            self.order.update((pickle.dumps(order),))
            moved = [(at, True) for at in sorted(after - before)] + [(at, False) for at in sorted(before - after)]
            yield pd.DataFrame({self.key: [key[0]] * len(moved), "lane": [key[1]] * len(moved), "id": [at[1] for at, _ in moved], "priority": [at[0] for at, _ in moved], "entered": [e for _, e in moved]}).astype({"lane": "int32"})

    def close(self) -> None:
        pass


def reservoir_stream(rows: DataFrame, key: str, n: int, of: str = "doc_id", seed: int = 0, lanes: int = 8) -> DataFrame:
    """Changes (key, lane, id, priority, entered) of the reservoirs of streamed rows
    (key, ``of``, further columns): rows that come in and rows that go. A key's rows
    are dealt by id to ``lanes`` reservoirs of n rows, which ``stored_reservoirs``
    merges; so a hot key is no single task. Ids are unique; rows whose id is null take
    no part. Needs the RocksDB state store."""
    kind = rows.schema[key].dataType.simpleString()
    payload = F.to_json(F.struct(*[c for c in rows.columns if c not in (key, of)]), {"ignoreNullFields": "false"}).cast("binary") if len(rows.columns) > 2 else F.lit(b"{}")
    dealt = rows.where(F.col(of).isNotNull()).select(key, F.pmod(F.xxhash64(of), F.lit(lanes)).cast("int").alias("lane"), F.col(of).cast("long").alias("id"), priority(F.col(of), seed).alias("priority"), payload.alias("payload"))
    return dealt.groupBy(key, "lane").transformWithStateInPandas(statefulProcessor=ReservoirProcessor(n, key), outputStructType=f"{key} {kind}, {CHANGES}", outputMode="Update", timeMode="None")


def stored_reservoirs(spark: SparkSession, checkpoint: str, key: str, n: int, payload: str = "", of: str = "doc_id") -> DataFrame:
    """(key, ``of``, priority, columns of the DDL ``payload``): what the state in a
    stream's checkpoint holds, the lanes of each key merged."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").load()
    rows = held.select(F.col(f"key.{key}").alias(key), F.col("user_map_key.id").alias(of), F.col("user_map_key.priority").alias("priority"), F.col("user_map_value.bytes").cast("string").alias("_row"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("priority", of))
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return rows.select(key, of, "priority", *([F.from_json("_row", payload).alias("_p")] if payload else [])).select(key, of, "priority", *(["_p.*"] if payload else []))
