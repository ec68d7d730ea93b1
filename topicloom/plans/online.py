"""Online learning as a query that runs: models are evaluated while documents arrive.

Every micro-batch writes what its filters tell, and the metrics of the models among
it, to folders that carry the batch's number. A batch that is run again after a
failure writes the same folders again, so nothing comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators import vocab
from topicloom.plans.evaluation import METRICS, evaluate_changes
from topicloom.plans.params import FilterParams
from topicloom.streaming import particle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The folder of what is told once a stream has ended.
LAST = -1


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that streams with state variables need. A
    query keeps the settings it started with."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


class OnlineRun:
    """Filters that learn from a stream of encoded documents (run_id, seed, ord,
    doc_id, category, word_ids), below one folder: ``marks`` is the checkpoint, ``rows``
    has REPLAYED rows, ``metrics`` (run_id, iter, metric, value), both by batch.

    ``test`` (doc_id, category, word_ids) is what emitted models are evaluated on: after
    the initial documents, every ``eval_every`` and, with ``finish``, the last. ``starts``
    are STARTS rows of runs that go on from a stored model. A run made anew over the same
    folder goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, path: str, params: FilterParams, vocab_size: int, test: DataFrame | None = None, starts: DataFrame | None = None, labelled: bool = True, eval_every: int = 50, seed_topics: list[tuple[int, int, int]] = ()):
        self.spark, self.path, self.p, self.vocab_size, self.test, self.starts = spark, path, params, vocab_size, test, starts
        self.how = {"eval_every": eval_every, "models": True, "labelled": labelled}
        self.params = params.dict() | {"seed_topics": list(seed_topics)}

    def start(self, docs: DataFrame, **trigger: object) -> StreamingQuery:
        """Starts the query; ``trigger`` as for ``DataStreamWriter.trigger``."""
        with rocksdb(self.spark):
            told = particle.report_stream(docs, self.params, self.vocab_size, starts=self.starts, **self.how)
            writer = told.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/marks").foreachBatch(self._write)
            return (writer.trigger(**trigger) if trigger else writer).start()

    def _write(self, told: DataFrame, batch: int) -> None:
        spark = told.sparkSession
        told.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        rows = spark.read.schema(particle.REPLAYED).parquet(f"{self.path}/rows/batch={batch}")
        found = particle.events_of(rows)
        models = particle.changes_of(rows)
        if self.test is not None and models.limit(1).count():
            p, how = self.p, self.how
            found = found.unionByName(evaluate_changes(models, self.test, self.vocab_size, p, how["labelled"], p.coherence_num_words))
        found.write.mode("overwrite").parquet(f"{self.path}/metrics/batch={batch}")

    def finish(self) -> DataFrame:
        """Once the query has stopped: the last evaluation and labels, from its state.
        Gives all particles' models, the reservoir and labels (``stored_rows``)."""
        rows = self.dump(finish=True)
        self._write(rows, LAST)
        return self.spark.read.schema(particle.REPLAYED).parquet(f"{self.path}/rows/batch={LAST}").where("kind in ('particle', 'reservoir', 'particle_label')")

    def dump(self, finish: bool = False, batch: int | None = None) -> DataFrame:
        """The whole state of a live or stopped query."""
        return particle.stored_rows(self.spark, f"{self.path}/marks", self.params, self.vocab_size, finish=finish, batch=batch, **self.how)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{particle.REPLAYED}, batch bigint").parquet(f"{self.path}/rows")

    def metrics(self) -> DataFrame:
        return self.spark.read.schema(f"{METRICS}, batch bigint").parquet(f"{self.path}/metrics").drop("batch")

    def labels(self) -> DataFrame:
        """(run_id, doc_id, label) as last told."""
        return particle.latest_labels(particle.labels_of(self.rows()))

    def model(self) -> DataFrame:
        """(run_id, topic, word_id, n) of the best particle at the last evaluation."""
        return particle.last_models(self.rows())


def stream_documents(docs: DataFrame, words: DataFrame, seed: int, run_id: str = "run.0") -> DataFrame:
    """What an OnlineRun learns from, of streamed documents (doc_id, category, tokens)
    and a vocabulary that is known before; unknown words have id 0. Documents are taken
    in the order of doc_id within a micro-batch, and as they arrive between them."""
    rows = docs.select(F.lit(run_id).alias("run_id"), F.lit(seed).cast("long").alias("seed"), F.col("doc_id").cast("long").alias("ord"), F.col("doc_id").cast("long").alias("doc_id"), "category", "tokens")
    return vocab.encode_rows(rows, words)
