"""Models of particles that resampling doesn't copy, and sweeps for few topics."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom.functions.rng import generator as rng_of
from topicloom.operators import gibbs
from topicloom.plans.evaluation import evaluate_changes, evaluate_models
from topicloom.plans.params import FilterParams
from topicloom.streaming import particle


@pytest.mark.parametrize("epochs", [3, 4096])
def test_models_are_those_that_are_copied(monkeypatch, epochs):
    monkeypatch.setattr(particle, "EPOCHS", epochs)
    rng, words, n, k = np.random.default_rng(1), 40, 5, 3
    held, copied = particle.Models(np.zeros((words, n, k), np.int32)), np.zeros((words, n, k), np.int32)
    for step in range(300):
        own = np.unique(rng.integers(0, words, 4))
        held.meet(own)
        assert (held.rows[own] == copied[own]).all()
        held.rows[own, step % n, step % k] += step
        copied[own, step % n, step % k] += step
        if rng.random() < 0.6:
            source = rng.integers(0, n, n)
            held.resampled(source)
            copied = copied[:, source]
        assert (held.of(step % n) == copied[:, step % n]).all()
        if step % 50 == 49:
            assert (held.met() == copied).all()


@pytest.mark.parametrize("few", [16, 0])
def test_a_step_costs_as_much_as_its_words(monkeypatch, few):
    """Whatever the vocabulary; resampling copied whole models."""
    monkeypatch.setattr(particle, "FEW_PARTICLES", few)
    params = FilterParams.of(num_particles=4, num_topics=3, reservoir_size=5, init_num_docs=0, rejuv_sample_size=2, ess_threshold=4.0).dict()

    def peak(vocab_size):
        pf = particle.ParticleFilter(params, vocab_size, 1)
        tracemalloc.start()
        try:
            for doc in range(12):
                pf.step(doc, [(doc + j) % 20 for j in range(15)])
            assert pf.version > 5
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(400_000) < 2 * peak(20)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_a_sweep_with_variables_is_the_sweep(monkeypatch, k):
    rng = np.random.default_rng(k)
    docs = [rng.integers(0, 50, int(n)).tolist() for n in rng.integers(0, 60, 80)]

    def chain():
        state = gibbs.learned(docs, k, 50, 0.1, 0.1, 3, 7, [(0, 4, 9)])
        state.sweep(rng_of(7, "more"), only=[3, 1, 60])
        return state.tw, state.t, state.z, state.dt, state.labels()

    few = chain()
    monkeypatch.setattr(gibbs, "FEW_TOPICS", 0)
    assert chain() == few


def test_few_topics_are_swept_faster(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 500, 300).astype(np.int32) for _ in range(200)]

    def seconds():
        spool = gibbs.spooled(docs, 4, 500, 0.1, 0.1, 0, 7)
        began = time.process_time()
        spool.sweep()
        return time.process_time() - began

    few = min(seconds() for _ in range(3))
    monkeypatch.setattr(gibbs, "FEW_TOPICS", 0)
    assert few < 0.9 * min(seconds() for _ in range(3))


def learner(models=True, every=5, turns=200, vocab_size=3000):
    params = FilterParams.of(num_particles=4, num_topics=3, reservoir_size=10, init_num_docs=6, init_num_iters=2, rejuv_sample_size=2, ess_threshold=3.0).dict()
    rng, recorder = np.random.default_rng(2), particle.Recorder(particle.ParticleFilter(params, vocab_size, 1), "r", every, models, True)
    for doc in range(turns):
        yield recorder, list(recorder.step(doc, (rng.integers(0, vocab_size, 12)).tolist(), str(doc % 2)))


def test_evaluated_models_are_told_as_changes(monkeypatch):
    """What is told grows with the documents gone by, not with models times words."""
    monkeypatch.setattr(particle.Recorder, "TOGETHER", 7)
    told, want = [], []
    for recorder, frames in learner():
        for rows in frames:
            told.append(rows)
            want.append((int(rows["iter"].iloc[0]), recorder.pf.tw[recorder.pf.best()].astype(np.int64)))
    rows = pd.concat(told).rename(columns={"n": "begun"})
    found = [(k, tw.copy()) for _, k, tw in particle.through(rows, 3000, 3)]
    assert len(found) == len(want) > 30 and len(set(rows["begun"])) == -(-len(want) // 7)
    assert all(a == c and (b == d).all() for (a, b), (c, d) in zip(found, want, strict=True))
    assert sum(len(x) // 2 for x in rows["ids"]) < 0.5 * sum(int((tw != 0).sum()) for _, tw in want)


def test_changes_are_scored_as_whole_models(spark, monkeypatch):
    monkeypatch.setattr(particle.Recorder, "TOGETHER", 4)
    told = pd.concat([rows for _, frames in learner(turns=80, vocab_size=60) for rows in frames])
    changes = spark.createDataFrame([(r.run_id, int(r.n), int(r.iter), int(r.topic), r.ids.tolist()) for r in told.itertuples()], "run_id string, begun bigint, iter bigint, topic int, ids array<int>")
    whole = [(run, k, t, int(w), int(tw[w, t])) for run, k, tw in particle.through(told.rename(columns={"n": "begun"}), 60, 3) for t in range(3) for w in np.flatnonzero(tw[:, t])]
    whole = spark.createDataFrame(whole, "run_id string, iter bigint, topic int, word_id int, n bigint")
    rng = np.random.default_rng(1)
    test = spark.createDataFrame([(d, "ab"[d % 2], rng.integers(0, 60, int(n)).tolist()) for d, n in enumerate(rng.integers(0, 20, 50))], "doc_id bigint, category string, word_ids array<int>")
    p = FilterParams.of(num_topics=3, init_seed=1, test_num_iters=2, ltr_eval=True, ltr_num_particles=2)
    want = {tuple(r)[:3]: pytest.approx(r.value) for r in evaluate_models(whole, test, 60, p, True, 5).collect()}
    assert len(want) == 6 * len(set(told["iter"]))
    for how in ({}, {"block_docs": 7}, {"block_tokens": 40, "together": 2}):
        assert {tuple(r)[:3]: r.value for r in evaluate_changes(changes, test, 60, p, True, 5, **how).collect()} == want


@pytest.mark.parametrize("many", [1000, 2])
def test_every_run_has_a_task_of_its_own(spark, monkeypatch, many):
    """A hash dealt two of these four into one of 16 parts."""
    monkeypatch.setattr(particle, "MANY_RUNS", many)
    runs = [f"{k}/run.{r}" for k in (0, 1) for r in (0, 1)]
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(run, 1, d, d, "ab"[d % 2], rng.integers(0, 20, 6).tolist()) for run in runs for d in range(12)], "run_id string, seed bigint, ord bigint, doc_id bigint, category string, word_ids array<int>")
    params = FilterParams.of(num_particles=2, num_topics=2, init_num_docs=3, init_num_iters=1).dict()
    replayed = particle.replay_all(docs, [params, params], 20)
    assert {r.run_id for r in replayed.select("run_id").distinct().collect()} == set(runs)
    tasks = replayed.select("run_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 4 and (many < 4 or len({r.task for r in tasks}) == 4)
