"""Whole workloads: batch learning, online filtering, model selection, sweeps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions.rng import generator
from topicloom.operators import counts as C
from topicloom.operators import gibbs, likelihood, selection, vocab
from topicloom.plans.evaluation import evaluate_changes, evaluate_models, top_words
from topicloom.plans.params import BatchParams, FilterParams, GibbsParams, ModelParams
from topicloom.sources.corpus import read_topic_list
from topicloom.sources.scratch import by_group, keep, spread
from topicloom.streaming import particle


@dataclass
class Run:
    """What a run gives: the seed it used, drawn or given; (iter, metric, value);
    the last model (topic, word_id, n); (iter, topic, rank, word, n) of each
    evaluated model; labels (doc_id, label) of training documents; the scores of
    tuning; and with ``debug`` all particles' models and the reservoir."""

    seed: int
    metrics: DataFrame
    model: DataFrame
    topics: DataFrame
    labels: DataFrame
    scores: DataFrame | None = None
    dump: DataFrame | None = None


def fresh_seed(seed: int) -> int:
    """A given seed as it is, else a random one, which the run reports."""
    return seed if seed >= 0 else int(np.random.default_rng().integers(1, 1 << 31))


def encoded_corpus(docs: DataFrame, oov_max_count: int = 1, test_in_vocab: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with word_ids, vocabulary): words of training documents only,
    unless asked otherwise. Both are written once and read by every step."""
    docs = spread(docs)
    train = docs if test_in_vocab else docs.where("split = 'train'")
    words = keep(vocab.build_vocab(train, oov_max_count), "vocab")
    ids = vocab.encode_docs(docs, words)
    none = F.array().cast("array<int>")
    rows = docs.select("doc_id", "category", "split").join(ids, "doc_id", "left").withColumn("word_ids", F.coalesce("word_ids", none))
    return keep(rows, "encoded"), words


def long_ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode("word_ids").alias("pos", "word_id"))


def evaluate(model: DataFrame, test: DataFrame, vocab_size: int, p: ModelParams, top_words: int = 10, labelled: bool = True) -> DataFrame:
    """(metric, value) of one topic-word table on encoded documents."""
    one = model.select(F.lit("run.0").alias("run_id"), F.lit(0).cast("long").alias("iter"), "topic", "word_id", "n")
    return evaluate_models(one, test, vocab_size, p, labelled, top_words).select("metric", "value")


def seed_list(spark: SparkSession, path: str, words: DataFrame, num_topics: int) -> list[tuple[int, int, int]]:
    """(topic, word_id, count) of a topic list's words in the vocabulary: as many
    rows as the list has. A list with more topics than the model raises."""
    if not path:
        return []
    none = spark.createDataFrame([], "topic int, word_id int, n long")
    return sorted((r.topic, r.word_id, r.n) for r in C.add_seed_topics(none, read_topic_list(spark, path), words, num_topics).collect())


def training(rows: DataFrame, p: ModelParams, seed: int) -> DataFrame:
    """Training documents of one run, in their order or shuffled by hash."""
    order = vocab.shuffle_key(F.col("doc_id"), seed) if p.shuffle_data else F.col("doc_id")
    return rows.where("split = 'train'").select(F.lit("run.0").alias("run_id"), F.lit(seed).cast("long").alias("seed"), order.alias("ord"), "doc_id", "category", "word_ids")


def reported(models: DataFrame, words: DataFrame, p: ModelParams) -> DataFrame:
    """(iter, topic, rank, word, n): the first words of every topic of each model;
    with ``skip_oov`` without the row of unknown words."""
    rank = F.row_number().over(Window.partitionBy("iter", "topic").orderBy(F.desc("n"), "word_id"))
    top = models.where("n > 0" + (" and word_id > 0" if p.skip_oov else "")).withColumn("rank", rank).where(F.col("rank") <= p.print_num_words_per_topic)
    return top.join(words.select("word_id", "word"), "word_id").select("iter", "topic", "rank", "word", "n")


def reported_changes(replayed: DataFrame, words: DataFrame, size: int, p: ModelParams) -> DataFrame:
    """The same of models that are told as what changed."""
    first = p.print_num_words_per_topic + p.skip_oov

    def best(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, k, tw in particle.through(pd.concat(list(batches)), size, p.num_topics):
            yield pd.DataFrame([(k, t, w, int(tw[w, t])) for t, top in enumerate(top_words(tw, first)) for w in top], columns=["iter", "topic", "word_id", "n"])

    top = particle.changes_of(replayed).groupBy("run_id", "begun").applyInPandas(best, "iter bigint, topic int, word_id int, n bigint")
    return reported(top, words, p)


def several(docs: DataFrame) -> bool:
    return docs.select("category").distinct().limit(2).count() > 1


def gibbs_trace(docs: DataFrame, params: dict, vocab_size: int, iters: int, every: int, debug: bool = False) -> DataFrame:
    """REPLAYED rows of exact Gibbs over documents (run_id, seed, ord, doc_id,
    category, word_ids): models and in-sample NMI (if there is more than one
    category) before the first sweep, after each ``every`` and after the last."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ord", "doc_id"])
        run, seed, category = rows["run_id"].iloc[0], int(rows["seed"].iloc[0]), [str(c) for c in rows["category"]]
        state = gibbs.GibbsState(params["num_topics"], vocab_size, params["alpha"], params["beta"])
        for topic, word, n in params.get("seed_topics", ()):
            state.add_seed(topic, word, n)
        state.start([[int(w) for w in words] for words in rows["word_ids"]], generator(seed, "init"))
        rng = generator(seed, "sweep")
        for k in range(iters + 1):
            if k:
                state.sweep(rng)
            if k % every == 0 or k == iters:
                if len(set(category)) > 1:
                    yield particle.frame("event", run, iter=k, metric="in_sample_nmi", value=particle.nmi(category, state.labels()))
                yield particle.model_rows(run, k, 0, np.array(state.tw))
        yield particle.frame("label", run, iter=iters, doc_id=[int(d) for d in rows["doc_id"]], topic=state.labels())
        if debug:
            yield particle.model_rows(run, iters, 0, np.array(state.tw)).assign(kind="particle")

    return by_group(docs, "run_id").groupBy("run_id").applyInPandas(kernel, particle.REPLAYED)


def _run(replayed: DataFrame, rows: DataFrame, words: DataFrame, size: int, p: ModelParams, seed: int, labelled: bool, coherence_words: int, scores: DataFrame | None = None, changes: bool = False) -> Run:
    test = rows.where("split = 'test'")
    if changes:
        found, topics = evaluate_changes(particle.changes_of(replayed), test, size, p, labelled, coherence_words), reported_changes(replayed, words, size, p)
        model = particle.last_models(replayed).select("topic", "word_id", "n")
    else:
        models = particle.models_of(replayed)
        found, topics = evaluate_models(models, test, size, p, labelled, coherence_words), reported(models, words, p)
        model = models.where(F.col("iter") == models.agg(F.max("iter")).first()[0]).select("topic", "word_id", "n")
    found = keep(particle.events_of(replayed).unionByName(found).select("iter", "metric", "value"), "metrics")
    dump = replayed.where("kind in ('particle', 'reservoir', 'particle_label')").drop("metric", "value") if p.debug else None
    return Run(seed, found, model, topics, particle.labels_of(replayed).select("doc_id", "label"), scores, dump)


def run_gibbs(docs: DataFrame, **given: object) -> Run:
    """Batch learning on labelled documents (doc_id, category, split, tokens),
    evaluated before the first sweep, after every tenth and after the last."""
    p = GibbsParams.of(**given)
    seed = fresh_seed(p.init_seed)
    rows, words = encoded_corpus(docs)
    size = words.count()
    train = vocab.take_first(training(rows, p, seed), p.init_num_docs, "ord")
    params = p.dict() | {"seed_topics": seed_list(docs.sparkSession, p.init_topic_list_filename, words, p.num_topics)}
    replayed = keep(gibbs_trace(train, params, size, p.init_num_iters, 10, p.debug), "gibbs")
    return _run(replayed, rows, words, size, p, seed, several(rows), p.coherence_num_words)


def run_batch(docs: DataFrame, **given: object) -> Run:
    """Batch learning on unlabelled documents, evaluated by likelihood before the
    first sweep and after the last."""
    p = BatchParams.of(**given)
    seed = fresh_seed(p.init_seed)
    rows, words = encoded_corpus(docs)
    size = words.count()
    train = vocab.take_first(training(rows, p, seed), p.num_docs, "ord").withColumn("category", F.lit("null"))
    replayed = keep(gibbs_trace(train, p.dict(), size, p.num_iters, max(p.num_iters, 1), p.debug), "gibbs")
    return _run(replayed, rows, words, size, p, seed, False, 0)


def run_filter(docs: DataFrame, **given: object) -> Run:
    """Online learning: Gibbs on the first documents, tuned over several runs if
    asked, whose winner's training documents alone seed the filter; then one pass
    over the rest, evaluated after the initial documents, every 50 and the last."""
    p = FilterParams.of(**given)
    seed = fresh_seed(p.init_seed)
    rows, words = encoded_corpus(docs)
    size = words.count()
    train = training(rows, p, seed)
    params = p.dict() | {"seed_topics": seed_list(docs.sparkSession, p.init_topic_list_filename, words, p.num_topics)}
    scores = None
    if p.init_tune_num_runs > 1:
        first = keep(vocab.take_first(train, p.init_num_docs, "ord"), "initial")
        scores = keep(select_model(first, size, p, seed, params["seed_topics"]), "scores")
        run, fold = winner(scores)
        held = keep(with_folds(first, p).where((F.col("fold") == fold) & F.col("held")).select("doc_id"), "held")
        train = train.join(held, "doc_id", "left_anti")
        params |= {"init_num_docs": first.count() - held.count(), "gibbs_seed": tuning_seed(seed, run)}
    replayed = keep(particle.replay_all(train, params, size, models=True, debug=p.debug), "filter")
    return _run(replayed, rows, words, size, p, seed, several(rows), p.coherence_num_words, scores, changes=True)


def tuning_seed(seed: int, run: int) -> int:
    return seed * 1000 + run


def with_folds(docs: DataFrame, p: FilterParams) -> DataFrame:
    """Documents by fold, and whether the fold holds them out: 0 folds hold out
    none, 1 fold a suffix, more folds each its part."""
    if p.init_tune_num_cv_folds > 1:
        own = vocab.kfold(docs.select("ord"), p.init_tune_num_cv_folds, "ord").select("ord", F.col("fold").alias("own"))
        rows = docs.join(own, "ord").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(p.init_tune_num_cv_folds - 1))))
        return rows.withColumn("held", F.col("own") == F.col("fold")).drop("own")
    if p.init_tune_num_cv_folds == 1:
        part = vocab.prefix_split(docs.select("ord"), p.init_tune_train_frac, "ord").select("ord", "part")
        return docs.join(part, "ord").withColumn("fold", F.lit(0)).withColumn("held", F.col("part") == "eval").drop("part")
    return docs.withColumn("fold", F.lit(0)).withColumn("held", F.lit(False))


def select_model(docs: DataFrame, vocab_size: int, p: FilterParams, seed: int = 0, seeds: list[tuple[int, int, int]] = (), seed_of: list[int] | None = None) -> DataFrame:
    """(run, fold, score) of init runs on documents (ord, doc_id, category,
    word_ids): 0 folds score NMI on the training documents, 1 fold holds out a
    suffix, more folds cross-validate. Scores are NMI, or minus the held-out
    perplexity. Run k starts from a seed of its own, or from ``seed_of[k]``."""
    jobs = with_folds(docs, p).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(p.init_tune_num_runs - 1))))
    k, alpha, beta = p.num_topics, p.alpha, p.beta

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "doc_id"])
        run, fold = int(rows["run"].iloc[0]), int(rows["fold"].iloc[0])
        fit, test = rows[~rows["held"]], rows[rows["held"]]
        start = seed_of[run] if seed_of else tuning_seed(seed, run)
        spool = gibbs.spooled(fit["word_ids"], k, vocab_size, alpha, beta, p.init_num_iters, start, seeds)
        state = spool.state
        by_nmi = p.init_tune_eval_nmi or p.init_tune_num_cv_folds == 0
        if not len(test):
            score = particle.nmi(fit["category"].tolist(), spool.labels()) if by_nmi else float("-inf")
        else:
            phi = (np.array(state.tw) + beta) / (np.array(state.t) + vocab_size * beta)
            held = test["word_ids"].tolist()
            if by_nmi:
                counts = gibbs.inferred_all(held, phi, k, alpha, p.test_num_iters, [generator(start, f"select{fold}", int(doc)) for doc in test["doc_id"]])
                score = particle.nmi(test["category"].tolist(), counts.argmax(1).tolist())
            else:
                n = sum(map(len, held))
                score = -float(np.exp(-likelihood.document_lls(held, phi, k, alpha).sum() / n)) if n else float("-inf")
        return pd.DataFrame({"run": [run], "fold": [fold], "score": [score]})

    return by_group(jobs.select("run", "fold", "held", "ord", "doc_id", "category", "word_ids"), "run", "fold").groupBy("run", "fold").applyInPandas(kernel, "run int, fold int, score double")


def best_of(scores: DataFrame) -> DataFrame:
    """The run with the best median over folds."""
    return selection.best_run(selection.upper_median(scores, "run"))


def winner(scores: DataFrame) -> tuple[int, int]:
    """The best run, and the fold of its upper median (the lowest of ties)."""
    run = best_of(scores).first().run
    folds = sorted((r.score, r.fold) for r in scores.where(F.col("run") == run).collect())  # a row a fold
    return run, folds[len(folds) // 2][1]


def find_seeds(docs: DataFrame, tries: int, **given: object) -> DataFrame:
    """(rank, seed, score): seeds of init runs, drawn from ``init_seed`` on, by the
    NMI of their initial documents. A run with that ``init_seed`` starts so."""
    p = FilterParams.of(**(given | {"init_tune_num_runs": tries, "init_tune_num_cv_folds": 0, "init_tune_eval_nmi": True}))
    seed_of = generator(fresh_seed(p.init_seed), "seeds").choice(1 << 30, tries, replace=False).tolist()
    rows, words = encoded_corpus(docs)
    first = vocab.take_first(training(rows, p, 0), p.init_num_docs, "ord")
    scores = select_model(first, words.count(), p, 0, seed_list(docs.sparkSession, p.init_topic_list_filename, words, p.num_topics), seed_of)
    named = scores.select(F.array(*map(F.lit, seed_of))[F.col("run")].cast("long").alias("seed"), "score")
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seed"))).select("rank", "seed", "score")  # a row a try


def sweep(spark: SparkSession, docs: DataFrame, vocab_size: int, settings: dict[str, list], replicas: int = 1, base: dict | None = None) -> DataFrame:
    """Filter metrics for every combination of settings times replicas of seeds:
    (settings..., run_id, iter, metric, value). All are runs of one job, each a task,
    whatever their number."""
    chosen = [dict(zip(settings, values, strict=True)) for values in product(*settings.values())]
    params = [FilterParams.of(**{**(base or {}), **c}).dict() for c in chosen]
    copies = F.explode(F.sequence(F.lit(0), F.lit(len(chosen) * replicas - 1))).alias("copy")  # a parameter
    rows = docs.select("doc_id", "category", "word_ids", copies).select(F.format_string("%d/run.%d", F.floor(F.col("copy") / replicas), F.col("copy") % replicas).alias("run_id"), (F.col("copy") % replicas).cast("long").alias("seed"), F.col("doc_id").alias("ord"), "doc_id", "category", "word_ids")
    found = particle.events_of(particle.replay_all(rows, params, vocab_size)).withColumn("_k", F.substring_index("run_id", "/", 1).cast("int"))
    names = [F.array(*[F.lit(c[name]) for c in chosen])[F.col("_k")].alias(name) for name in settings]
    return found.select(*names, F.substring_index("run_id", "/", -1).alias("run_id"), "iter", "metric", "value")
