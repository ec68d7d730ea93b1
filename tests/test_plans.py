"""Sweeps as one job, evaluation in groups, printed topics, and how small inputs are dealt."""

import pytest
from pyspark.sql import functions as F

from topicloom.operators import counts
from topicloom.plans import runs
from topicloom.plans.evaluation import evaluate_models
from topicloom.plans.params import FilterParams
from topicloom.sources import corpus
from topicloom.sources.scratch import by_group, keep, spread
from topicloom.streaming import particle


@pytest.fixture(scope="module")
def encoded(spark):
    docs = corpus.generate_corpus(spark, 50, 12, 3, 30, seed=8)
    return keep(docs.select("doc_id", "category", F.transform("tokens", lambda t: t.cast("int")).alias("word_ids")), "docs"), 30


def test_sweep_is_one_job_with_the_same_runs(spark, encoded):
    docs, size = encoded
    base = {"num_particles": 3, "init_num_docs": 10, "init_num_iters": 2, "reservoir_size": 10, "rejuv_sample_size": 2, "ess_threshold": 2.0}
    found = runs.sweep(spark, docs, size, {"num_topics": [2, 3], "alpha": [0.1, 0.5]}, 2, base)
    assert found.columns == ["num_topics", "alpha", "run_id", "iter", "metric", "value"]
    got = {tuple(r) for r in found.collect()}
    for k, alpha in ((2, 0.1), (2, 0.5), (3, 0.1), (3, 0.5)):
        for seed in (0, 1):
            rows = docs.select(F.lit(f"run.{seed}").alias("run_id"), F.lit(seed).alias("seed"), F.col("doc_id").alias("ord"), "doc_id", "category", "word_ids")
            one = particle.events_of(particle.replay_all(rows, FilterParams.of(num_topics=k, alpha=alpha, **base).dict(), size))
            assert {(k, alpha, *r) for r in one.collect()} == {x for x in got if x[:3] == (k, alpha, f"run.{seed}")}


def test_models_in_groups(spark, encoded):
    docs, size = encoded
    tokens = counts.initial_topics(runs.long_ids(docs), 3, 1)
    model = counts.topic_word(tokens)
    models = None
    for k in range(5):
        part = model.select(F.lit("r").alias("run_id"), F.lit(k).cast("long").alias("iter"), ((F.col("topic") + k) % 3).alias("topic"), "word_id", (F.col("n") + k).alias("n"))
        models = part if models is None else models.union(part)
    models, p = keep(models, "models"), FilterParams.of(num_topics=3, init_seed=2)
    together = {tuple(r)[:3]: r.value for r in evaluate_models(models, docs, size, p, True, 5).collect()}
    apart = {tuple(r)[:3]: r.value for r in evaluate_models(models, docs, size, p, True, 5, block_docs=9, group_mb=0).collect()}
    assert together == {k: pytest.approx(v) for k, v in apart.items()} and len(together) == 5 * 4


def test_printed_topics_without_unknown_words(spark):
    docs = corpus.generate_corpus(spark, 40, 10, 2, 200, seed=3)
    with_all = runs.run_gibbs(docs, num_topics=2, init_num_iters=1, init_seed=1).topics
    known = runs.run_gibbs(docs, num_topics=2, init_num_iters=1, init_seed=1, skip_oov="true").topics
    assert with_all.where("word = '_OOV_'").count() and not known.where("word = '_OOV_'").count()
    assert known.where("rank = 1").count() == with_all.where("rank = 1").count()


def test_small_inputs_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(rows).rdd.getNumPartitions() == 2 * cores and spread(rows).count() == 100
    assert spread(rows, part_bytes=1).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert by_group(rows, "id").rdd.getNumPartitions() >= 4 * cores
