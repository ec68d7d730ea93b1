"""Topic counts and the conditional posterior as DataFrame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.rng import token_hash, uniform


def initial_topics(tokens: DataFrame, num_topics: int, seed: int) -> DataFrame:
    """Adds ``topic``: uniform by the token's hash."""
    return tokens.withColumn("topic", F.pmod(token_hash(F.col("doc_id"), F.col("pos"), 0, seed), F.lit(num_topics)).cast("int"))


def topic_word(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("topic", "word_id").agg(F.count("*").alias("n"))


def topic_totals(counts: DataFrame) -> DataFrame:
    """Totals from topic-word counts: far fewer rows than tokens."""
    return counts.groupBy("topic").agg(F.sum("n").alias("n"))


def doc_topic(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("doc_id", "topic").agg(F.count("*").alias("n"))


def add_seed_topics(counts: DataFrame, seeds: DataFrame, vocab: DataFrame, num_topics: int) -> DataFrame:
    """Topic-word counts plus those of a topic list, for words in the vocabulary.
    A list with more topics than the model raises."""
    seeds = seeds.withColumn("topic", F.when(F.col("topic") < num_topics, F.col("topic")).otherwise(F.raise_error(F.lit("more seed topics than topics")).cast("int")))
    known = seeds.join(vocab.select("word", "word_id"), "word").select("topic", "word_id", "n")
    return counts.select("topic", "word_id", "n").unionByName(known).groupBy("topic", "word_id").agg(F.sum("n").alias("n"))


def ranked_words(counts: DataFrame, top: int | None = None) -> DataFrame:
    """(topic, rank, word_id, n), by falling count, then by id; a limit keeps
    only the heads of the groups from the sort on."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "word_id"))
    rows = counts.where("n > 0").withColumn("rank", rank)
    return (rows.where(F.col("rank") <= top) if top else rows).select("topic", "rank", "word_id", "n")


def inferred_topic(doc_counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, topic) for each document: the topic with most tokens, the lowest
    of ties, 0 where there are none. One aggregation, no sort of groups."""
    best = doc_counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("topic")).alias("t"))).alias("b")).select("doc_id", (-F.col("b.t")).alias("topic"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("topic", F.lit(0)).cast("int").alias("topic"))


def topic_array(rows: DataFrame, key: str, num_topics: int, name: str) -> DataFrame:
    """(key, counts of topics 0..K-1 as one array): from here on a token joins
    one row of each table, not K."""
    sums = [F.coalesce(F.sum(F.when(F.col("topic") == k, F.col("n"))), F.lit(0)).alias(f"_{k}") for k in range(num_topics)]
    return rows.groupBy(key).agg(*sums).select(key, F.array(*[f"_{k}" for k in range(num_topics)]).alias(name))


def total_array(totals: DataFrame, num_topics: int) -> list[int]:
    """Topic totals, K numbers, on the driver."""
    held = {r.topic: r.n for r in totals.collect()}
    return [int(held.get(k, 0)) for k in range(num_topics)]


def posterior(tw: Column, t: Column, dt: Column, n_d: Column, vocab_size: int, num_topics: int, alpha: float, beta: float) -> Column:
    """(tw + beta) / (t + V beta) * (dt + alpha) / (n_d + K alpha); the last
    denominator stays, so the sum over topics is the word's probability."""
    return (tw + F.lit(beta)) / (t + F.lit(vocab_size * beta)) * ((dt + F.lit(alpha)) / (n_d + F.lit(num_topics * alpha)))


def with_counts(assignments: DataFrame, num_topics: int, tw: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """Assignments with the arrays _tw of their word and _dt of their document,
    and the topic totals. The document side needs no shuffle of its own where
    tokens are partitioned by document."""
    counts = topic_word(assignments) if tw is None else tw
    totals = total_array(topic_totals(counts), num_topics)
    words = topic_array(counts, "word_id", num_topics, "_tw")
    docs = topic_array(doc_topic(assignments), "doc_id", num_topics, "_dt")
    return assignments.join(words, "word_id").join(docs, "doc_id"), totals


def posterior_array(totals: list[int], vocab_size: int, alpha: float, beta: float, leave_out: bool) -> Column:
    """The posterior of a token over all topics, from _tw and _dt; without the
    token itself if asked."""
    k_all = len(totals)
    n_d = F.aggregate("_dt", F.lit(0).cast("long"), lambda a, x: a + x) - (1 if leave_out else 0)

    def one(k: int) -> Column:
        own = F.when(F.col("topic") == k, 1).otherwise(0) if leave_out else F.lit(0)
        return posterior(F.get("_tw", F.lit(k)) - own, F.lit(totals[k]) - own, F.get("_dt", F.lit(k)) - own, n_d, vocab_size, k_all, alpha, beta)

    return F.array(*[one(k) for k in range(k_all)])


def draw(pmf: Column, u: Column, num_topics: int) -> Column:
    """The first topic whose running sum exceeds u times the total, else the
    last."""
    sums = [reduce(lambda a, k: a + F.get(pmf, F.lit(k)), range(1, j + 1), F.get(pmf, F.lit(0))) for j in range(num_topics)]
    out = F.lit(num_topics - 1)
    for k in reversed(range(num_topics - 1)):
        out = F.when(u * sums[-1] < sums[k], k).otherwise(out)
    return out.cast("int")


def sync_sweep(assignments: DataFrame, num_topics: int, vocab_size: int, sweep: int, alpha: float = 0.1, beta: float = 0.1, seed: int = 0) -> DataFrame:
    """One synchronous sweep: every token draws from the last counts without
    itself. An approximation of the sequential sampler that needs one shuffle by
    word and one by document, whatever the number of topics."""
    joined, totals = with_counts(assignments, num_topics)
    drawn = joined.withColumn("_p", posterior_array(totals, vocab_size, alpha, beta, True))
    topic = draw(F.col("_p"), uniform(F.col("doc_id"), F.col("pos"), sweep, seed), num_topics)
    return drawn.select("doc_id", "pos", "word_id", topic.alias("topic"))


def topic_model(counts: DataFrame, num_topics: int, vocab_size: int, beta: float = 0.1) -> DataFrame:
    """(word_id, phi): smoothed word probabilities of each topic."""
    totals = total_array(topic_totals(counts), num_topics)
    words = topic_array(counts, "word_id", num_topics, "_tw")
    phi = F.array(*[(F.get("_tw", F.lit(k)) + F.lit(beta)) / F.lit(totals[k] + vocab_size * beta) for k in range(num_topics)])
    return words.select("word_id", phi.alias("phi"))


def unseen_phi(counts: DataFrame, num_topics: int, vocab_size: int, beta: float = 0.1) -> list[float]:
    """Probabilities of a word that no topic holds."""
    return [beta / (n + vocab_size * beta) for n in total_array(topic_totals(counts), num_topics)]
