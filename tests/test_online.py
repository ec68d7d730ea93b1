"""Online learning on streams: against replays, after failures, from stored models; reservoirs."""

import pytest
from pyspark.sql import functions as F

from topicloom.operators import gibbs, vocab
from topicloom.plans import online, runs
from topicloom.plans.params import FilterParams
from topicloom.sources import corpus
from topicloom.streaming import particle, reservoir

SMALL = {"num_topics": 3, "num_particles": 5, "init_num_docs": 20, "init_num_iters": 5, "reservoir_size": 25, "rejuv_sample_size": 3, "ess_threshold": 3.0, "init_seed": 1}


def in_files(docs, path, n):
    """Documents as files in their order, one a micro-batch."""
    last = docs.agg(F.max("ord")).first()[0] + 1
    for k in range(n):
        docs.where((F.col("ord") >= k * last // n) & (F.col("ord") < (k + 1) * last // n)).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, docs, path):
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)


def told(df, digits=9):
    return sorted((r.iter, r.metric, None if r.value is None else round(r.value, digits)) for r in df.collect())


def state(df):
    """Rows of a dump, without their order."""
    return sorted(str((r.kind, r.run_id, r.particle, r.topic, r.word_id, r.n, r.doc_id, r.ids)) for r in df.where("kind in ('particle', 'reservoir', 'particle_label')").collect())


@pytest.fixture(scope="module")
def learned(spark):
    docs = corpus.generate_corpus(spark, 230, 12, 3, 30, seed=5)
    run = runs.run_filter(docs, **SMALL, debug=True)
    p = FilterParams.of(**SMALL)
    rows, words = runs.encoded_corpus(docs)
    train = runs.training(rows, p, 1)
    return run, p, runs.keep(train, "train"), runs.keep(rows.where("split = 'test'"), "test"), words.count()


def test_stream_evaluates_like_a_run(spark, learned, tmp_path):
    run, p, train, test, size = learned
    in_files(train, str(tmp_path / "in"), 4)
    stream = online.OnlineRun(spark, str(tmp_path / "run"), p, size, test)
    stream.start(streamed(spark, train, str(tmp_path / "in")), availableNow=True).awaitTermination()
    dump = stream.finish()
    assert told(stream.metrics()) == told(run.metrics)
    assert {(r.doc_id, r.label) for r in stream.labels().collect()} == {(r.doc_id, r.label) for r in run.labels.collect()}
    assert state(dump) == state(run.dump.withColumn("run_id", F.lit("run.0")))
    assert {tuple(r)[1:] for r in stream.model().collect()} == {tuple(r) for r in run.model.collect()}


def test_killed_stream_tells_nothing_twice(spark, learned, tmp_path):
    run, p, train, test, size = learned
    in_files(train, str(tmp_path / "in"), 4)

    class Killed(online.OnlineRun):
        def _write(self, rows, batch):
            super()._write(rows, batch)
            if batch == 2:
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        Killed(spark, str(tmp_path / "run"), p, size, test).start(streamed(spark, train, str(tmp_path / "in")), availableNow=True).awaitTermination()
    again = online.OnlineRun(spark, str(tmp_path / "run"), p, size, test)
    live = again.start(streamed(spark, train, str(tmp_path / "in")), processingTime="1 second")
    live.processAllAvailable()
    middle = again.dump()  # while the query runs
    live.stop()
    again.finish()
    assert told(again.metrics()) == told(run.metrics)
    assert {(r.doc_id, r.label) for r in again.labels().collect()} == {(r.doc_id, r.label) for r in run.labels.collect()}
    n = train.count()
    assert middle.where("kind = 'particle'").agg(F.sum("n")).first()[0] == 5 * 12 * n
    # the state after an earlier batch is what a replay of its documents ends with
    part = train.where(F.col("ord") < train.agg(F.max("ord")).first()[0] // 2 + 1)
    early = particle.replay_all(part, again.params, size, debug=True)
    ends = again.dump(batch=1)
    assert ends.where("kind = 'particle'").agg(F.sum("n")).first()[0] in (5 * 12 * train.where(F.col("ord") < 2 * (train.agg(F.max("ord")).first()[0] + 1) // 4).count(), 5 * 12 * part.count())
    assert early.where("kind = 'particle'").count() > 0


@pytest.mark.parametrize("given", [{}, {"forget_stats": True}, {"reservoir_size": 8}])
def test_stream_starts_from_a_stored_model(spark, learned, tmp_path, given):
    _, p, train, test, size = learned
    p = FilterParams.of(**(SMALL | given))
    first = runs.keep(train.orderBy("ord").limit(20), "first")
    rest = train.join(first.select("doc_id"), "doc_id", "left_anti").select(*train.columns)
    assigned = gibbs.gibbs_runs(first, size, 3, p.alpha, p.beta, p.init_num_iters).join(first.drop("run_id", "word_ids"), "doc_id")
    starts = runs.keep(particle.starts_from(assigned, p.dict()), "starts")
    in_files(rest, str(tmp_path / "in"), 3)
    stream = online.OnlineRun(spark, str(tmp_path / "run"), p, size, None, starts)
    stream.start(streamed(spark, rest, str(tmp_path / "in")), availableNow=True).awaitTermination()
    dump = stream.finish()
    replayed = runs.keep(particle.replay_all(rest, p.dict(), size, debug=True, starts=starts), "replayed")
    assert told(stream.metrics()) == told(particle.events_of(replayed))
    assert state(dump) == state(replayed)
    whole = runs.keep(particle.replay_all(train, p.dict(), size, debug=True), "whole")
    if p.reservoir_size >= 20:  # then the filter's own first step keeps the same documents
        assert told(particle.events_of(whole)) == told(particle.events_of(replayed))
        assert state(whole) == state(replayed)
    tokens = 12 * (train.count() if not p.forget_stats else p.reservoir_size)
    assert replayed.where("kind = 'particle'").agg(F.sum("n")).first()[0] == 5 * tokens


def test_a_run_that_meets_no_document(spark, learned, tmp_path):
    """It stands in the state as it starts, and can be dumped."""
    _, p, train, _, size = learned
    docs = train.orderBy("ord").limit(10)
    assigned = docs.withColumn("topics", F.transform("word_ids", lambda w: w % 3)).withColumn("run_id", F.lit("other"))
    starts = particle.starts_from(assigned, p.dict())
    train.limit(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = online.OnlineRun(spark, str(tmp_path / "run"), p, size, None, starts)
    stream.start(streamed(spark, train, str(tmp_path / "in")), availableNow=True).awaitTermination()
    dump = runs.keep(stream.dump(), "dump")
    found = {r.run_id: r.n for r in dump.where("kind = 'particle'").groupBy("run_id").agg(F.sum("n").alias("n")).collect()}
    assert found == {"other": 5 * 120}
    assert {(r.run_id, r.doc_id) for r in dump.where("kind = 'waiting'").collect()} == {("run.0", r.doc_id) for r in train.limit(3).collect()}


def test_texts_are_encoded_on_the_stream(spark, tmp_path):
    """From tokens to metrics in one query, as a run over the same documents."""
    docs = corpus.generate_corpus(spark, 120, 12, 3, 30, seed=6)
    run = runs.run_filter(docs, **SMALL)
    train = runs.keep(docs.where("split = 'train'").select("doc_id", "category", "tokens"), "tokens")
    words = runs.keep(vocab.build_vocab(train), "words")
    test = runs.keep(vocab.encode_rows(docs.where("split = 'test'").select("doc_id", "category", "tokens"), words), "coded")
    rows, _ = runs.encoded_corpus(docs)
    assert {(r.doc_id, *r.word_ids) for r in test.collect()} == {(r.doc_id, *r.word_ids) for r in rows.where("split = 'test'").collect()}
    in_files(train.withColumn("ord", F.col("doc_id")), str(tmp_path / "in"), 3)
    read = spark.readStream.schema("doc_id long, category string, tokens array<string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = online.OnlineRun(spark, str(tmp_path / "run"), FilterParams.of(**SMALL), words.count(), test)
    stream.start(online.stream_documents(read, words, 1), availableNow=True).awaitTermination()
    stream.finish()
    assert told(stream.metrics()) == told(run.metrics)
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, ["nowhere", words.where("word_id = 1").first().word], None)], "doc_id long, tokens array<string>, more string")
    assert [tuple(r) for r in vocab.encode_rows(odd, words).orderBy("doc_id").collect()] == [(1, [], "x"), (2, [], "y"), (3, [0, 1], None)]


def test_reservoirs(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("category"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("extra"))
    want = {}
    for r in rows.withColumn("p", reservoir.priority(F.col("doc_id"), 4)).collect():
        want.setdefault(r.category, []).append((r.p, r.doc_id))
    want = {(c, d) for c, x in want.items() for _, d in sorted(x)[:40]}
    batch = reservoir.reservoir_by_key(rows, "category", 40, "doc_id", 4)
    assert {(r.category, r.doc_id) for r in batch.collect()} == want
    cut = reservoir.reservoir_by_key(rows, "category", 1200, "doc_id", 4).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in cut}["hot"] == 1200 and sum(r["count"] for r in cut) == 1200 + 4000 - 1334
    rows.orderBy(F.rand(1)).repartition(5).write.parquet(str(tmp_path / "in"))
    spark.conf.set(online.PROVIDER, online.ROCKSDB)
    changes = reservoir.reservoir_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), "category", 40, "doc_id", 4, lanes=3)
    q = changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).start()
    q.awaitTermination()
    held = reservoir.stored_reservoirs(spark, str(tmp_path / "marks"), "category", 40, "text string, extra bigint").collect()
    assert {(r.category, r.doc_id) for r in held} == want and len(held) == len(want)
    assert all(r.text == f"t{r.doc_id}" and r.extra == (r.doc_id if r.doc_id % 2 == 0 else None) for r in held)
    # changes add up to the lanes, and a full lane takes few rows
    out = spark.read.parquet(str(tmp_path / "out"))
    lanes = out.groupBy("category", "lane").agg(F.sum(F.when(F.col("entered"), 1).otherwise(-1)).alias("n"))
    assert lanes.agg(F.max("n")).first()[0] == 40 and out.count() < 3000
