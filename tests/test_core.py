"""Topic analytics: SQL oracles, closed-form cases, sampler invariants."""

import glob
import math
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom import queries as core
from topicloom.functions import text as T
from topicloom.functions.rng import generator
from topicloom.operators import counts, gibbs, likelihood, metrics, selection, trace, vocab
from topicloom.plans import runs
from topicloom.plans.params import BatchParams, FilterParams, GibbsParams
from topicloom.sources import corpus
from topicloom.streaming import particle

SF = "/root/testdata/sf0.001"


def rows_of(rows):
    return sorted((tuple("~" if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_oracle(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({core.SQL[name]}) AS q").fetchall()
    assert rows_of(df.select(*cols).collect()) == rows_of(want)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_tokenizers(spark):
    assert one(spark, lambda x: T.nonempty(T.whitespace_tokens(x)), "don't stop 42 Now") == ["stop", "Now"]
    assert one(spark, T.nonalpha_tokens, "ab1 cd--é e1") == ["ab", "cd", "e", ""]
    assert one(spark, lambda x: T.prepared(x, stop=["the"]), "The THE cat") == ["cat"]
    assert one(spark, lambda x: T.after_header(T.lines(x)), "a: b\n \nbody\n\nmore") == ["body", "", "more"]
    assert one(spark, lambda x: T.after_header(T.lines(x)), "no blank line") == []
    assert one(spark, lambda x: T.without_walls(T.lines(x)), "one two\nwall \n\n a") == ["one two", " a"]
    assert one(spark, T.paragraphs, "<P>a</P><pre>x</pre><p class=1>b\nc</p>") == ["a", "b\nc"]
    assert T.categories("3") == ("0", "1", "2") and len(T.categories("tng")) == 20


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, ["a", "c", "b"]), (2, ["c", "a", "c"])], "doc_id long, tokens array<string>")
    words = vocab.build_vocab(docs)
    assert {(r.word, r.word_id, r.n) for r in words.collect()} == {("_OOV_", 0, 1), ("a", 1, 2), ("c", 2, 3)}
    assert {r.doc_id: r.word_ids for r in vocab.encode_docs(docs, words).collect()} == {1: [1, 2, 0], 2: [2, 1, 2]}
    stripped = {r.doc_id: r.tokens for r in vocab.strip_singletons(docs, "RARE").collect()}
    assert stripped[1] == ["a", "c", "RARE"]


def test_single_words_go_without_moving_the_others(spark):
    """Against a plain loop, single words at ends and beside each other, repeated and
    null ids; no join is by word, which would bring a frequent word into one task."""
    rng = random.Random(4)
    rows = [(k if k % 7 else None, [rng.choice("abcde") if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(12))]) for k in range(60)]
    rows += [(100, ["only", "lonely"]), (101, ["first", "a", "last"]), (102, []), (103, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    n = Counter(w for _, t in rows for w in t or [])
    for twice in (False, True):
        held: dict = {}
        for k, t in rows:
            key = k if not twice or k is None else k % 50
            held.setdefault(key, []).extend((p, w) for p, w in enumerate(t or []))
        frame = docs.withColumn("doc_id", F.col("doc_id") % 50) if twice else docs
        for rare in (None, "RARE"):
            out = vocab.strip_singletons(frame, rare)
            got = {r.doc_id: r.tokens for r in out.collect()}
            want = {k: [w if n[w] > 1 else rare for _, w in sorted(t) if n[w] > 1 or rare] for k, t in held.items()}
            assert got == {k: t for k, t in want.items() if t}
    assert not [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "word#" in x]


def test_splits(spark):
    docs = spark.range(8).select(F.col("id").alias("doc_id"))
    sizes = vocab.kfold(docs, 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2]
    assert vocab.kfold(docs, 10).select("fold").distinct().count() == 8
    assert vocab.sample_without_replacement(docs.limit(3), 5, 1).count() == 3
    assert [r.doc_id for r in corpus.numbered(docs.withColumnRenamed("doc_id", "k").repartition(5), ["k"]).orderBy("k").collect()] == list(range(8))


def test_ids_are_dense_at_scale(spark):
    """More rows than the range sampler sees, with a further column, at three widths."""
    n = 400_000
    rows = spark.range(0, n, numPartitions=7).select(((F.col("id") * 7919 + 13) % n).alias("k"), F.md5(F.col("id").cast("string")).alias("text"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("3", "16", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            got = corpus.numbered(rows, ["k"]).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.max("doc_id").alias("last"), F.sum((F.col("k") != F.col("doc_id")).cast("int")).alias("off")).first()
            assert tuple(got) == (n, n, n - 1, 0)
            split = corpus.split_exact(rows, "k", 0.6, 1).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).collect()
            assert {tuple(r) for r in split} == {("train", 240_000, 240_000), ("test", 160_000, 160_000)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    words = rows.select(F.col("k").alias("doc_id"), F.array(F.substring("text", 1, 4), F.substring("text", 5, 4)).alias("tokens"))
    built = vocab.build_vocab(words, 0)
    ids = built.where("word_id > 0").orderBy("word").collect()
    assert [r.word_id for r in ids] == list(range(1, len(ids) + 1)) and len(ids) > 60_000


def test_metrics(spark):
    same = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 1)], "label string, topic int")
    assert metrics.agreement(same, "label", "topic").first().nmi == pytest.approx(1)
    flat = same.withColumn("topic", F.lit(0))
    assert metrics.agreement(flat, "label", "topic").first().nmi == pytest.approx(0)
    assert metrics.agreement(same.where("false"), "label", "topic").first().nmi == 0
    part = metrics.agreement(same, "label", "topic", ["a"]).first()
    assert part.h_label == pytest.approx(-0.5 * math.log(0.5)) and part.mi == pytest.approx(0.5 * math.log(2))
    assert particle.nmi(["a", "a", "b", "b"], [0, 0, 1, 1]) == pytest.approx(1) and particle.nmi(["a", "b"], [0, 0]) == 0
    uniform = spark.range(100).select(F.col("id").alias("particle"), F.lit(1.0).alias("weight"))
    assert metrics.effective_sample_size(uniform).first().ess == pytest.approx(100)
    assert selection.upper_median(spark.createDataFrame([(1, x) for x in (4.0, 1.0, 9.0, 2.0)], "run int, score double"), "run").first().score == 4
    tied = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0)], "run int, score double")
    assert selection.best_run(tied).first().run == 1
    tokens = spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "doc_id long, word_id int")
    top = spark.createDataFrame([(0, 1, 9), (0, 2, 5), (0, 3, 6)], "topic int, rank int, word_id int")
    r = metrics.coherence(tokens, top, 1).first()
    assert r.skipped == 2 and r.coherence == pytest.approx(math.log(2) - math.log(2))
    assert math.isinf(metrics.coherence(tokens, top, 1, strict=True).first().coherence)


def test_inferred_topic_ties(spark):
    dt = spark.createDataFrame([(1, 2, 5), (1, 1, 5), (1, 0, 2)], "doc_id long, topic int, n long")
    got = counts.inferred_topic(dt, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert {r.doc_id: r.topic for r in got.collect()} == {1: 1, 2: 0}


def test_first_moment(spark):
    tw = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (0, 2, 2), (1, 1, 4), (1, 2, 1)], "topic int, word_id int, n long")
    tokens = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 2, 2)], "doc_id long, pos int, word_id int")
    phis = likelihood.with_phi(tokens, tw, 2, 3, 0.1)
    for f in (likelihood.first_moment, likelihood.first_moment_arrow):
        assert f(phis, 2).first().ll == pytest.approx(-3.6001305528428644)
    none = likelihood.perplexity(likelihood.first_moment(phis.where("false"), 2)).first()
    assert none.perplexity is None
    empty = likelihood.with_phi(tokens, spark.createDataFrame([(0, 9, 0), (1, 9, 0)], "topic int, word_id int, n long"), 2, 3, 0.1)
    assert likelihood.perplexity(likelihood.first_moment(empty, 2)).first().perplexity == pytest.approx(3)
    ltr = likelihood.left_to_right(phis, 2, particles=400).first()
    assert abs(ltr.ll - -3.6) < 0.2


def test_seed_topics(spark):
    with pytest.raises(Exception, match="count"):
        corpus.parse_topics(spark.createDataFrame([(0, "a 1 b")], "topic int, value string")).collect()
    seeds = spark.createDataFrame([(5, "a", 1)], "topic int, word string, n long")
    words = spark.createDataFrame([("a", 1, 3)], "word string, word_id int, n long")
    with pytest.raises(Exception, match="more seed topics"):
        counts.add_seed_topics(spark.createDataFrame([], "topic int, word_id int, n long"), seeds, words, 3).collect()


def generated(spark, **how):
    docs = corpus.generate_corpus(spark, seed=3, **how)
    encoded, words = runs.encoded_corpus(docs.withColumn("split", F.lit("train")), 0)
    return encoded, words.count()


def test_generator_does_not_depend_on_partitions(spark):
    a = corpus.generate_corpus(spark, 40, 20, 3, 30, seed=2).collect()
    b = corpus.generate_corpus(spark, 40, 20, 3, 30, seed=2).repartition(7).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and all(len(r.tokens) == 20 for r in a)


def test_exact_gibbs(spark):
    docs, size = generated(spark, num_docs=150, num_words=50, num_topics=3, vocab_size=60)
    jobs = docs.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("run_id", F.format_string("run.%d", "seed")).select("run_id", "seed", "doc_id", "word_ids")
    state = gibbs.gibbs_runs(jobs, size, 3, iters=30)
    held = state.collect()
    assert all(len(r.word_ids) == len(r.topics) for r in held) and len(held) == 300
    label = {r.doc_id: r.category for r in docs.collect()}
    best = 0.0
    for run in ("run.1", "run.2"):
        mine = [r for r in held if r.run_id == run]
        best = max(best, particle.nmi([label[r.doc_id] for r in mine], [int(np.bincount(r.topics, minlength=3).argmax()) for r in mine]))
    assert best > 0.5
    again = gibbs.gibbs_runs(jobs.repartition(5), size, 3, iters=30).collect()
    assert sorted(map(str, held)) == sorted(map(str, again))
    counted = counts.topic_word(gibbs.assignments(state)).agg(F.sum("n")).first()[0]
    assert counted == 2 * 150 * 50


def test_distributed_gibbs_learns(spark):
    from topicloom.sources.scratch import keep

    docs, size = generated(spark, num_docs=150, num_words=50, num_topics=3, vocab_size=60)
    state = gibbs.distributed_gibbs(docs, keep, size, 3, iters=20, seed=1)
    label = {r.doc_id: r.category for r in docs.collect()}
    rows = state.collect()
    assert particle.nmi([label[r.doc_id] for r in rows], [int(np.bincount(r.topics, minlength=3).argmax()) for r in rows]) > 0.4
    with pytest.raises(ValueError):
        gibbs.distributed_gibbs(docs, keep, 10**9, 100)


def small_filter(**given):
    return FilterParams.of(**({"num_particles": 6, "num_topics": 3, "reservoir_size": 10, "init_num_docs": 8, "init_num_iters": 5, "rejuv_sample_size": 4, "ess_threshold": 3.0} | given)).dict()


def random_docs(n, size=30, seed=0):
    rng = random.Random(seed)
    return [(k, str(k % 3), [rng.randrange(size // 3) + (k % 3) * (size // 3) for _ in range(12)]) for k in range(n)]


@pytest.mark.parametrize("given", [{}, {"reservoir_size": 0}, {"reservoir_size": 1000}, {"forget_stats": True}, {"resample_per_token": True}, {"num_particles": 1, "ess_threshold": 2.0}, {"init_num_docs": 0}])
def test_filter_invariants(given):
    p = small_filter(**given)
    pf = particle.ParticleFilter(p, 30, 1)
    for k, (doc, category, words) in enumerate(random_docs(60), 1):
        pf.step(doc, words)
        if not pf.ready:
            continue
        assert pf.weights.sum() == pytest.approx(1) and len(pf.weights) == p["num_particles"]
        assert (pf.tw >= 0).all() and (pf.tw.sum(1) == pf.t).all()
        assert len(pf.reservoir) == min(p["reservoir_size"], k)
        if not p["forget_stats"]:
            assert (pf.t.sum(1) == 12 * k).all()
        else:
            assert (pf.t.sum(1) == 12 * len(pf.reservoir)).all()
        for d in pf.reservoir:
            assert (pf._dt(d).sum(1) == len(d.words)).all()
    assert set(pf.labels.of(pf.best())) == set(range(60))


def through_bytes(pf):
    """The filter as the stream's state holds it, and the sizes of its values."""
    import pickle

    labels = {d: pickle.dumps((v, x, 0, pf.about[d])) for d, (v, x) in pf.labels.open.items()}
    values = [pf.small()], pf.particle_parts(), [pickle.dumps(d) for d in pf.reservoir], [pickle.dumps(x) for x in pf.waiting], labels
    held = [len(x) for part in values for x in (part.values() if isinstance(part, dict) else part)]
    return particle.ParticleFilter.restored(values[0][0], *values[1:]), held


def test_filter_survives_bytes():
    a = particle.ParticleFilter(small_filter(), 30, 1)
    b = particle.ParticleFilter(small_filter(), 30, 1)
    settled, largest = {}, []
    for doc, _, words in random_docs(160):
        a.step(doc, words)
        b.step(doc, words)
        settled |= b.settle()
        b, sizes = through_bytes(b)
        largest.append(max(sizes))
    assert (a.tw == b.tw).all() and (a.weights == b.weights).all()
    assert a.labels.of(a.best()) == settled | b.labels.of(b.best())
    # no value of the state grows with the documents gone by
    assert max(largest[100:]) <= 1.3 * max(largest[20:60])
    assert len(b.labels.open) < 80


def test_labels_follow_ancestors():
    """Against labels that are copied at every resampling."""
    rng = np.random.default_rng(3)
    held, copied = particle.Labels(5), {}
    for doc in range(200):
        if rng.random() < 0.3:
            source = rng.integers(0, 5, 5)
            held.resampled(source)
            copied = {d: x[source] for d, x in copied.items()}
        for d in (doc, int(rng.integers(0, doc + 1))):
            copied[d] = rng.integers(0, 3, 5)
            held.give(d, copied[d])
        if doc % 7 == 0:
            held.settle()
        p = int(rng.integers(0, 5))
        assert held.of(p) == {d: int(x[p]) for d, x in copied.items()}
    assert len(held.open) < 100 and len(held.sources) < 60


def test_resampling_keeps_places():
    pf = particle.ParticleFilter(small_filter(num_particles=4, reservoir_size=0, init_num_docs=0), 30, 1)
    for k in range(4):
        pf.tw[k, 0, 0] = pf.t[k, 0] = k + 1
    pf.weights = np.array([0.0, 0.0, 1.0, 0.0])
    pf._resample(particle.Stored(0, np.zeros(0, np.int64), np.zeros((4, 0), np.int64)))
    assert (pf.tw[:, 0, 0] == 3).all() and (pf.weights == 0.25).all()


def test_stream_equals_replay(spark, tmp_path):
    docs = spark.createDataFrame([(f"run.{r}", r, k, k, c, w) for r in (1, 2) for k, c, w in random_docs(45, seed=r)], "run_id string, seed long, ord long, doc_id long, category string, word_ids array<int>")
    p = small_filter()
    want = {(r.run_id, r.doc_id): r.label for r in particle.labels_of(particle.replay_all(docs, p, 30)).collect()}
    for k in range(3):
        docs.where((F.col("ord") >= 15 * k) & (F.col("ord") < 15 * k + 15)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = particle.filter_stream(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), p, 30)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))).start()
    q.awaitTermination()
    got = {(r.run_id, r.doc_id): r.label for r in particle.latest_labels(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == want
    emitted = spark.read.parquet(str(tmp_path / "out"))
    assert emitted.count() < 2 * len(want) and emitted.groupBy("run_id", "doc_id", "version").count().where("count > 1").count() == 0


def test_model_selection(spark):
    docs, size = generated(spark, num_docs=60, num_words=30, num_topics=3, vocab_size=40)
    docs = docs.withColumn("ord", F.col("doc_id"))
    for folds, nmi in ((0, True), (1, False), (3, False), (3, True)):
        p = FilterParams.of(num_topics=3, init_num_iters=5, init_tune_num_runs=3, init_tune_num_cv_folds=folds, init_tune_eval_nmi=nmi)
        scores = runs.select_model(docs, size, p)
        assert scores.count() == 3 * max(folds, 1)
        assert runs.best_of(scores).first().run in range(3)


def metrics_of(run):
    out = {}
    for r in run.metrics.collect():
        out.setdefault(r.metric, {}).setdefault(r.iter, []).append(r.value)
    return out


def test_run_gibbs(spark):
    docs = corpus.generate_corpus(spark, 120, 30, 3, 40, seed=5)
    run = runs.run_gibbs(docs, num_topics="3", init_num_iters="23", init_seed="1", ltr_eval="true", ltr_num_particles="3", print_num_words_per_topic="4")
    found = metrics_of(run)
    names = {"in_sample_nmi", "out_of_sample_nmi", "out_of_sample_perplexity", "out_of_sample_log_likelihood", "out_of_sample_ltr_perplexity", "out_of_sample_ltr_log_likelihood", "out_of_sample_coherence"}
    assert set(found) == names and all(sorted(found[m]) == [0, 10, 20, 23] for m in names)
    assert found["out_of_sample_perplexity"][23][0] < found["out_of_sample_perplexity"][0][0] < 45
    assert found["in_sample_nmi"][23][0] > found["in_sample_nmi"][0][0]
    top = run.topics.collect()
    assert {r.iter for r in top} == {0, 10, 20, 23} and max(r["rank"] for r in top) == 4 and run.seed == 1
    batch = metrics_of(runs.run_batch(docs, num_topics=3, num_iters=4, init_seed=1))
    assert {m: sorted(x) for m, x in batch.items()} == dict.fromkeys(("out_of_sample_log_likelihood", "out_of_sample_perplexity"), [0, 4])
    shuffled = runs.run_gibbs(docs, num_topics=3, init_num_iters=1, init_num_docs=10, init_seed=1, shuffle_data=True).labels.collect()
    assert len(shuffled) == 10 and {r.doc_id for r in shuffled} != {r.doc_id for r in docs.where("split = 'train'").orderBy("doc_id").limit(10).collect()}
    drawn = runs.run_gibbs(docs, num_topics=3, init_num_iters=1)
    assert drawn.seed >= 0


def test_evaluation_equals_the_operators(spark):
    docs, size = generated(spark, num_docs=50, num_words=25, num_topics=3, vocab_size=40)
    tokens = counts.initial_topics(runs.long_ids(docs), 3, 1)
    model, p = counts.topic_word(tokens), FilterParams.of(num_topics=3, init_seed=2)
    found = {r.metric: r.value for r in runs.evaluate(model, docs, size, p, 5).collect()}
    phis = likelihood.with_phi(tokens, model, 3, size, 0.1)
    ll = likelihood.perplexity(likelihood.first_moment(phis, 3)).first()
    assert found["out_of_sample_log_likelihood"] == pytest.approx(ll.ll) and found["out_of_sample_perplexity"] == pytest.approx(ll.perplexity)
    assert found["out_of_sample_coherence"] == pytest.approx(metrics.coherence(tokens, counts.ranked_words(model, 5), 3).first().coherence)
    topics = gibbs.infer(phis, 3, 0.1, 5, 2)
    sent = likelihood.sent_model(model, 3, size, 0.1)
    same = gibbs.infer_docs(docs, sent, 3, 0.1, 5, 2)
    assert sorted(map(str, topics.collect())) == sorted(map(str, same.collect()))
    assert found["out_of_sample_nmi"] == pytest.approx(metrics.agreement(topics.join(docs, "doc_id"), "category", "topic").first().nmi)
    assert likelihood.perplexity(likelihood.first_moment_docs(docs, sent, 3)).first().ll == pytest.approx(ll.ll)
    with pytest.raises(ValueError):
        likelihood.sent_model(model, 3, 10**9, 0.1)
    blocks = runs.evaluate_models(model.selectExpr("'r' run_id", "7L iter", "topic", "word_id", "n"), docs, size, p, True, 5, block_docs=7)
    assert {r.metric: pytest.approx(r.value) for r in blocks.collect()} == found


def test_run_filter(spark, tmp_path):
    docs = corpus.generate_corpus(spark, 190, 12, 3, 30, seed=5)
    small = {"num_topics": 3, "num_particles": 5, "init_num_docs": 20, "init_num_iters": 5, "reservoir_size": 20, "rejuv_sample_size": 3, "ess_threshold": 2.0, "init_seed": 1}
    n = docs.where("split = 'train'").count()
    run = runs.run_filter(docs, **small, debug=True)
    found = metrics_of(run)
    cadence = [20, *range(50, n, 50), n]
    for m in ("init_in_sample_nmi", "in_sample_nmi", "out_of_sample_nmi", "out_of_sample_perplexity", "out_of_sample_log_likelihood", "out_of_sample_coherence", "ess"):
        assert sorted(found[m]) == cadence and all(len(x) == 1 for x in found[m].values()), m
    assert set(trace.STATS) <= set(found) and set(trace.EVENTS) <= set(found) | {"resampling"}
    assert sorted(found["num_words"]) == list(range(20, n)) and [found["token"][k][0] for k in (20, 21, n - 1)] == [240, 252, 12 * (n - 1)]
    assert run.labels.count() == n and {r.iter for r in run.topics.select("iter").distinct().collect()} == set(cadence)
    dump = run.dump.where("kind <> 'particle_label'").groupBy("kind").agg(F.count_distinct("particle").alias("particles"), F.count_distinct("doc_id").alias("docs"), F.sum("n").alias("tokens")).collect()
    assert {r.kind: (r.particles, r.docs, r.tokens) for r in dump} == {"particle": (5, 0, 5 * 12 * n), "reservoir": (5, 20, None)}
    short = metrics_of(runs.run_filter(docs, **(small | {"init_num_docs": 500})))
    assert sorted(short["in_sample_nmi"]) == [n] and "num_words" not in short

    # the winner's training documents alone seed the filter
    tuned = runs.run_filter(docs, **(small | {"init_tune_num_runs": 3, "init_tune_num_cv_folds": 4, "init_num_docs": 40}))
    assert tuned.scores.count() == 12 and tuned.labels.count() == n - 10
    assert min(metrics_of(tuned)["in_sample_nmi"]) == 30

    # seed topics stay in every model
    (tmp_path / "topics").write_text("3 500 5 100\nnowhere 4\n")
    seeded = runs.run_filter(docs, **small, init_topic_list_filename=str(tmp_path / "topics"))
    assert seeded.model.agg(F.sum("n")).first()[0] == 12 * n + 600
    with pytest.raises(Exception, match="more seed topics"):
        (tmp_path / "many").write_text("3 1\n" * 4)
        runs.run_filter(docs, **small, init_topic_list_filename=str(tmp_path / "many"))


def test_seed_search(spark):
    docs = corpus.generate_corpus(spark, 80, 20, 3, 30, seed=5)
    given = {"num_topics": 3, "init_num_docs": 30, "init_num_iters": 4, "num_particles": 2, "init_seed": 3}
    ranked = runs.find_seeds(docs, 5, **given).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5] and len({r.seed for r in ranked}) == 5
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
    again = metrics_of(runs.run_filter(docs, **(given | {"init_seed": ranked[0].seed})))
    assert again["init_in_sample_nmi"][30][0] == pytest.approx(ranked[0].score)


def test_parameters():
    assert BatchParams.of(shuffle_data="0").shuffle_data is False and BatchParams.of(shuffle_data="True").shuffle_data is True
    assert FilterParams.of(alpha="0.5").alpha == 0.5
    with pytest.raises(ValueError):
        GibbsParams.of(reservoir_size="3")
    for bad in ({"ess-threshold": "3"}, {"resample_propagate": "1"}, {"num_docs": "3"}):
        with pytest.raises(ValueError):
            FilterParams.of(**bad)
    with pytest.raises(ValueError):
        FilterParams.of(init_tune_num_runs=2, init_tune_num_cv_folds=0)
    assert generator(1, "a", 2).random() == generator(1, "a", 2).random() != generator(1, "b", 2).random()


def test_trace(spark):
    lines = ["num words: 7", "doc: 1", "In-Sample NMI: 0.5", "resampling", "resampling: ", "doc: x", "In-Sample NMI: 9"]
    got = trace.parse(spark.createDataFrame([("r", k, v) for k, v in enumerate(lines)], "run string, line long, value string"), first_iter=100).collect()
    assert {(r.iter, r.metric, r.value) for r in got} == {(100, "num_words", "7"), (1, "in_sample_nmi", "0.5"), (1, "resampling", "")}
    twice = [("a", 0, "doc: 3"), ("a", 1, "in-sample nmi: 10.5"), ("a", 2, "in-sample nmi: 9.5"), ("b", 0, "doc: 3"), ("b", 1, "in-sample nmi: 9"), ("b", 2, "in-sample nmi: 10")]
    wide = trace.stat_pivot(trace.parse(spark.createDataFrame(twice, "run string, line long, value string")), "in_sample_nmi", ["a", "b"])
    assert [tuple(r) for r in wide.collect()] == [(3, "9.5", "10")]


def test_a_run_is_parsed_in_blocks(spark, tmp_path):
    """One run's lines, wherever blocks and splits end: values are those of a plain
    loop, and no task has them all."""
    lines = [f"doc: {k}" if k % 50 == 7 else f"In-Sample NMI: {k}" for k in range(600)]
    want, at = set(), -1
    for line in lines:
        key, value = line.split(": ")
        at = int(value) if key == "doc" else at
        want |= {(at, value)} if key != "doc" else set()
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame([("r", k << 16, v) for k, v in enumerate(lines)], "run string, line long, value string")
        got = trace.parse(rows, first_iter=-1).select("iter", "value", F.spark_partition_id().alias("part")).collect()
        assert {(r.iter, r.value) for r in got} == want and len(got) == len(want) and len({r.part for r in got}) > 1
        bad = rows.union(spark.createDataFrame([("r", (300 << 16) + 1, "doc: x")], rows.schema))
        assert {r.value for r in trace.parse(bad, first_iter=-1).collect()} == {v for _, v in want if int(v) <= 300}
        (tmp_path / "logs" / "d").mkdir(parents=True)
        (tmp_path / "logs" / "d" / "a.log").write_bytes("\r\n".join(lines).encode())
        read = trace.read_logs(spark, str(tmp_path / "logs")).orderBy("line").collect()
        assert [(r.dataset, r.log, r.value) for r in read] == [("d", "a.log", v) for v in lines]
        assert trace.process_logs(spark, str(tmp_path / "logs"), str(tmp_path / "out")) == {"d": ["a.log"]}
        table = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "d_in_sample_nmi")).collect()
        last = {}
        for i, v in sorted(want, key=lambda x: int(x[1])):
            last[i] = v
        assert sorted((int(r.iter), r["run.0"]) for r in table) == sorted((i, v) for i, v in last.items() if i >= 0)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_process_logs(spark, tmp_path):
    for dataset, log, text in (("diff3", "b.log", "seed: 1\ndoc: 1\nin-sample nmi: 0.25\nresampling: \nresampling: \n"), ("diff3", "a.log", "doc: 1\nin-sample nmi: 0.5\ndoc: 2\nin-sample nmi: 0.75\n"), ("diff3", "c.log", "nothing: 1\n"), ("sim3", "a.log", "doc: 7\nnum words: 4\n")):
        (tmp_path / "logs" / dataset).mkdir(parents=True, exist_ok=True)
        (tmp_path / "logs" / dataset / log).write_text(text)
    assert trace.process_logs(spark, str(tmp_path / "logs"), str(tmp_path / "out")) == {"diff3": ["a.log", "b.log"], "sim3": ["a.log"]}

    def read(name):
        return [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / name)).collect()]

    assert read("diff3_in_sample_nmi") == [("1", "0.5", "0.25"), ("2", "0.75", "NA")]
    assert read("diff3_resampling") == [("1", "0", "2")] and read("sim3_num_words") == [("7", "4")]
    assert read("sim3_in_sample_nmi") == []


def test_sources(spark, tmp_path):
    (tmp_path / "posts" / "a.b").mkdir(parents=True)
    (tmp_path / "posts" / "a.b" / "1").write_text("From: x\n\nThe cat sat here.\nwall\n")
    (tmp_path / "posts" / "a.b" / ".hidden").write_text("no\n\nno no\n")
    posts = corpus.read_newsgroup_tree(spark, str(tmp_path / "posts"), "train")
    got = corpus.transform_newsgroups(posts, ["file"], stop=["the"]).collect()
    assert [(r.doc_id, r.category, r.tokens) for r in got] == [(0, "a.b", ["cat", "sat", "here"])]
    (tmp_path / "stop").write_text("a \n\nthe\n")
    assert {r.word for r in corpus.read_stop_list(spark, str(tmp_path / "stop")).collect()} == {"a", "the"}
    (tmp_path / "topics").write_text("x 3 y 2\n\nz 1\n")
    assert {tuple(r) for r in corpus.read_topic_list(spark, str(tmp_path / "topics")).collect()} == {(0, "x", 3), (0, "y", 2), (1, "z", 1)}
    news = spark.createDataFrame([(1, "<DOC id=1><HEADLINE>No</HEADLINE><P>Yes one</P></DOC><doc><p>two</p></doc>")], "k long, text string")
    assert sorted(r.tokens for r in corpus.transform_newswire(news, "k").collect()) == [["two"], ["yes", "one"]]


def test_command_line(spark, tmp_path, capsys):
    import gzip

    from topicloom.__main__ import main

    at = {k: str(tmp_path / k) for k in ("c", "news", "wire", "tweets", "tree", "tree_test", "out", "a", "b")}
    assert main(["generate", at["c"], "--num_docs=60", "--num_words=20", "--num_topics=3", "--vocab_size=30", "--seed=1"]) == 0
    assert main(["gibbs", at["c"], "3", "--num_topics=3", "--init_num_iters=3", "--init_seed=1"]) == 0
    said = capsys.readouterr().out
    assert "out of sample perplexity" in said and "seed: 1" in said and "topic 0, 1: " in said
    assert main(["batch", at["c"], "--num_topics=3", "--num_iters=2"]) == 0
    assert main(["seeds", at["c"], "3", "2", "--num_topics=3", "--init_num_iters=2"]) == 0
    assert "1: seed " in capsys.readouterr().out
    (tmp_path / "wire").mkdir()
    with gzip.open(tmp_path / "wire" / "x.gz", "wt") as f:
        f.write("<DOC id=1>\n<P>\nOne two\n</P>\n</DOC>\n<DOC id=2>\n<P>\nthree\n</P>\n</DOC>\n")
    assert main(["newswire", at["wire"], at["news"], "--lower=1"]) == 0
    assert sorted(r.tokens for r in corpus.read_labelled(spark, at["news"]).collect()) == [["one", "two"], ["three"]]
    (tmp_path / "tw.txt").write_text("1 hello world\n2 good day 3\n")
    assert main(["tweets", str(tmp_path / "tw.txt"), at["tweets"]]) == 0
    assert sorted(r.tokens for r in corpus.read_labelled(spark, at["tweets"]).collect()) == [["good", "day"], ["hello", "world"]]
    for tree in ("tree", "tree_test"):
        (tmp_path / tree / "sci").mkdir(parents=True)
        (tmp_path / tree / "sci" / "1").write_text("From: x\n\nA cat sat\n")
    assert main(["newsgroups", at["tree"], at["tree_test"], at["out"], "--remove_header=true", "--lower=yes"]) == 0
    assert [(r.category, r.tokens) for r in corpus.read_labelled(spark, at["out"]).collect()] == [("sci", ["a", "cat", "sat"])] * 2
    assert main(["annotate", at["out"], at["a"]]) == 0 and main(["flatten", at["a"], at["b"]]) == 0
    assert corpus.read_labelled(spark, at["b"]).count() == 2
    assert [r.file.split("/")[-1] for r in corpus.sorted_files(spark, at["tree"]).orderBy("file_no").collect()] == ["1"]
    with pytest.raises(ValueError):
        main(["generate", at["c"], "--no=1"])
    assert main(["nothing"]) == 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())


def test_library_stands_alone():
    """Nothing outside the subpackage imports it."""
    import pathlib
    import re

    root = pathlib.Path(core.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"topicloom\.llm|corpus_pipeline", path.read_text()), path


def test_a_spooled_chain_is_the_chain_and_holds_a_chunk():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, int(n)).astype(np.int32) for n in rng.integers(0, 40, 300)]
    want = gibbs.learned([d.tolist() for d in docs], 3, 50, 0.1, 0.1, 2, 7, [(1, 4, 9)])
    state = gibbs.GibbsState(3, 50, 0.1, 0.1)
    state.add_seed(1, 4, 9)
    spool = gibbs.Spool(state, 7, chunk=500)
    for words in docs:
        spool.add(words)
    spool.flush()
    for _ in range(2):
        spool.sweep()
    assert len(spool.places) > 5 and state.tw == want.tw and state.t == want.t and spool.labels() == want.labels()
    assert [z for held in spool.taken() for z in held.z] == want.z

    def peak(n):
        tracemalloc.start()
        gibbs.spooled((np.full(500, k % 50, np.int32) for k in range(n)), 3, 50, 0.1, 0.1, 1, 7)
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    gibbs.Spool.__init__.__defaults__, was = (20_000,), gibbs.Spool.__init__.__defaults__
    try:
        assert peak(1200) < 1.3 * peak(200)
    finally:
        gibbs.Spool.__init__.__defaults__ = was


def test_runs_in_one_task_are_sampled_apart(spark):
    rows = [(f"r{d % 5}", 1, d, [d % 7, 3, 1][: d % 4]) for d in range(60)]
    docs = spark.createDataFrame(rows, "run_id string, seed int, doc_id long, word_ids array<int>")
    found = {(r.run_id, r.doc_id): list(r.topics) for r in gibbs.gibbs_runs(docs, 7, 3, iters=2).collect()}
    want = {}
    for k in range(5):
        own = [(d, w) for run, _, d, w in rows if run == f"r{k}"]
        want |= {(f"r{k}", d): z for (d, _), z in zip(own, gibbs.learned([w for _, w in own], 3, 7, 0.1, 0.1, 2, 1).z, strict=True)}
    assert found == want


@pytest.mark.parametrize("k, forget, size", [(2, False, 6), (3, True, 4), (4, False, 0), (3, False, 30)])
def test_plain_numbers_are_what_vectors_are(monkeypatch, k, forget, size):
    rng = random.Random(k)
    docs = [[rng.randrange(30) for _ in range(rng.choice([0, 1, 7, 25]))] for _ in range(60)]
    params = FilterParams.of(num_particles=5, num_topics=k, reservoir_size=size, init_num_docs=8, init_num_iters=2, rejuv_sample_size=3, rejuv_mcmc_steps=2, ess_threshold=4.0, forget_stats=forget).dict()

    def state():
        pf = particle.ParticleFilter(params, 30, 5)
        for d, words in enumerate(docs):
            pf.step(d, words, "a")
        return pf.tw.tolist(), pf.t.tolist(), pf.weights.tolist(), [d.z.tolist() for d in pf.reservoir], pf.version, pf.labels.of(pf.best())

    plain = state()
    monkeypatch.setattr(particle, "FEW_PARTICLES", 0)
    assert plain == state() and plain[4] > 0


def test_left_to_right_of_many_is_that_of_each(spark):
    rng, k, alpha, particles = np.random.default_rng(2), 3, 0.1, 4
    docs = [rng.random((int(n), k)) for n in [0, 1, 9, 4, 9, 30]]
    found = likelihood.particles_lls(docs, k, alpha, particles, [generator(1, "ltr", d) for d in range(len(docs))])
    for d, phi in enumerate(docs):
        own, z, dt, ll = generator(1, "ltr", d), np.zeros((particles, len(phi)), int), np.zeros((particles, k)), 0.0
        for j in range(len(phi)):
            for i in range(j + 1):
                u = own.random(particles)
                for m in range(particles):
                    dt[m, z[m, i]] -= i < j
                c = np.cumsum(phi[i] * (dt + alpha), 1)
                ll += np.log((c[:, -1] / (j + k * alpha)).mean()) if i == j else 0.0
                z[:, i] = (c[:, :-1] <= (u * c[:, -1])[:, None]).sum(1)
                for m in range(particles):
                    dt[m, z[m, i]] += 1
        assert found[d] == pytest.approx(ll, abs=1e-9)
    # few bytes are work for many tasks: documents stay dealt
    tokens = spark.createDataFrame([(d, j, j, 0) for d in range(40) for j in range(3)], "doc_id long, pos int, word_id int, topic int")
    phis = likelihood.with_phi(tokens, counts.topic_word(tokens), 2, 3, 0.1)
    assert phis.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_documents_side_by_side_are_each_alone():
    rng, k = np.random.default_rng(3), 3
    phi = rng.random((20, k))
    docs = [rng.integers(0, 20, int(n)).astype(np.int32) for n in [5, 0, 40, 1, 40, 7]]
    alone = [gibbs.inferred(d.tolist(), phi.tolist(), k, 0.1, 4, generator(1, "infer", i)) for i, d in enumerate(docs)]
    assert gibbs.inferred_all(docs, phi, k, 0.1, 4, [generator(1, "infer", i) for i in range(len(docs))]).tolist() == alone
    for words, ll in zip(docs, likelihood.document_lls(docs, phi, k, 0.1), strict=True):
        dt, want = np.full(k, 0.1), 0.0
        for n, w in enumerate(words):
            x = phi[w] * dt
            want, dt = want + math.log(x.sum() / (n + 0.3)), dt + x / x.sum()
        assert ll == pytest.approx(want, abs=1e-9)
    assert not len(likelihood.document_lls([], phi, k, 0.1)) and not len(gibbs.inferred_all([], phi, k, 0.1, 1, []))


def test_document_frequencies_do_not_meet_at_words(spark):
    """Tokens are looked up where they are; a frequent word is no single task."""
    plan = core.QUERIES["doc_freq"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
