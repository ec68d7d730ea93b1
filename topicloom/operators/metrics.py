"""Evaluation: entropies, mutual information, coherence, particle statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entropy(rows: DataFrame, key: str, values: list | None = None) -> DataFrame:
    """(entropy) of the shares of ``key`` in natural logs; with ``values``, other
    values count in the total only."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    counts = counts.where(F.col(key).isin(values)) if values is not None else counts
    return counts.agg(F.coalesce(-F.sum(F.col("p") * F.ln("p")), F.lit(0.0)).alias("entropy"))


def contingency(rows: DataFrame, label: str, topic: str) -> DataFrame:
    """One small table for all of A9-A12: (label, topic, c, m1, m2, n)."""
    cells = rows.groupBy(label, topic).agg(F.count("*").alias("c"))
    return cells.select(F.col(label).alias("label"), F.col(topic).alias("topic"), "c", F.sum("c").over(Window.partitionBy(label)).alias("m1"), F.sum("c").over(Window.partitionBy(topic)).alias("m2"), F.sum("c").over(Window.partitionBy()).alias("n"))


def agreement(rows: DataFrame, label: str, topic: str, labels: list | None = None) -> DataFrame:
    """(mi, h_label, h_topic, nmi): from one contingency table. Labels outside
    ``labels`` drop out of mi and h_label but count in n; nmi is 0 where both
    entropies are."""
    cells = contingency(rows, label, topic)
    known = F.col("label").isin(labels) if labels is not None else F.lit(True)
    c, n = F.col("c"), F.col("n")
    mi = F.sum(F.when(known, c / n * (F.ln(c.cast("double") * n) - F.ln(F.col("m1").cast("double") * F.col("m2")))))
    # marginal entropies from cells: each cell carries its share of p ln p
    h1 = -F.sum(F.when(known, c / n * F.ln(F.col("m1") / n)))
    h2 = -F.sum(c / n * F.ln(F.col("m2") / n))
    sums = cells.agg(*[F.coalesce(x, F.lit(0.0)).alias(k) for k, x in (("mi", mi), ("h_label", h1), ("h_topic", h2))])
    return sums.withColumn("nmi", F.when(F.col("h_label") + F.col("h_topic") > 0, 2 * F.col("mi") / (F.col("h_label") + F.col("h_topic"))).otherwise(0.0))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "word_id").distinct().groupBy("word_id").agg(F.count("*").alias("df"))


def codocument_frequency(tokens: DataFrame, top: DataFrame) -> DataFrame:
    """(topic, rank_i, rank_j, codf) for pairs i > j of each topic's top words
    (topic, rank, word_id) that share a document. Only a topic's own top words
    meet, within a document: at most M * M / 2 pairs a document and topic."""
    held = tokens.select("doc_id", "word_id").join(F.broadcast(top.select("topic", "rank", "word_id")), "word_id").select("topic", "doc_id", "rank").distinct()  # top: K * M rows
    per_doc = held.groupBy("topic", "doc_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).where(F.size("ranks") > 1)
    pairs = per_doc.select("topic", F.explode("ranks").alias("rank_i"), "ranks").select("topic", "rank_i", F.explode(F.filter("ranks", lambda r: r < F.col("rank_i"))).alias("rank_j"))
    return pairs.groupBy("topic", "rank_i", "rank_j").agg(F.count("*").alias("codf"))


def coherence(tokens: DataFrame, top: DataFrame, num_topics: int, strict: bool = False) -> DataFrame:
    """(coherence, skipped): the mean over topics of sums of ln(codf(i, j) + 1) -
    ln(df(j)) for i > j. Pairs with df(j) = 0 are skipped and counted; strict
    makes the result infinite instead."""
    df = tokens.select("doc_id", "word_id").join(F.broadcast(top.select("word_id").distinct()), "word_id").select("word_id", "doc_id").distinct().groupBy("word_id").agg(F.count("*").alias("df"))
    codf = codocument_frequency(tokens, top)
    ranked = top.groupBy("topic").agg(F.collect_list("rank").alias("all"))  # M ranks a topic
    j = top.select("topic", F.col("rank").alias("rank_j"), "word_id")
    pairs = j.join(ranked, "topic").select("topic", "word_id", "rank_j", F.explode(F.filter("all", lambda r: r > F.col("rank_j"))).alias("rank_i"))
    pairs = pairs.join(df, "word_id", "left").join(codf, ["topic", "rank_i", "rank_j"], "left")
    gone = F.coalesce("df", F.lit(0)) == 0
    term = F.when(gone, F.lit(float("inf")) if strict else F.lit(0.0)).otherwise(F.ln(F.coalesce("codf", F.lit(0)) + 1.0) - F.ln(F.col("df").cast("double")))
    return pairs.agg((F.coalesce(F.sum(term), F.lit(0.0)) / num_topics).alias("coherence"), F.coalesce(F.sum(gone.cast("long")), F.lit(0)).alias("skipped"))


def effective_sample_size(particles: DataFrame, *by: str) -> DataFrame:
    """1 / sum of squared normalised weights."""
    total = F.sum("weight").over(Window.partitionBy(*by))
    return particles.withColumn("w", F.col("weight") / total).groupBy(*by).agg((1 / F.sum(F.col("w") * F.col("w"))).alias("ess"))


def normalised_weights(particles: DataFrame, *by: str) -> DataFrame:
    return particles.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by)))


def best_particle(particles: DataFrame, *by: str) -> DataFrame:
    """The particle of largest weight, the first of ties."""
    best = F.max(F.struct("weight", (-F.col("particle")).alias("p"))).alias("b")
    return particles.groupBy(*by).agg(best).select(*by, (-F.col("b.p")).alias("particle"), F.col("b.weight").alias("weight"))


def resample_plan(particles: DataFrame, draws: DataFrame, by: str) -> DataFrame:
    """(by, particle, source): which particle each one becomes. Draws (by, draw,
    u) pick by cumulative weight; a picked particle keeps its place, its further
    picks fill the places of unpicked ones in order."""
    w = Window.partitionBy(by).orderBy("particle")
    cmf = particles.withColumn("high", F.sum("weight").over(w)).withColumn("low", F.col("high") - F.col("weight")).withColumn("last", F.col("particle") == F.max("particle").over(Window.partitionBy(by)))
    hit = (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | F.col("last"))
    picks = draws.join(cmf, by).where(hit).select(by, "draw", "particle")
    times = picks.groupBy(by, "particle").agg(F.count("*").alias("times"))
    extra = times.select(by, F.col("particle").alias("source"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).where("copy > 1")
    extra = extra.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("source", "copy")))
    free = particles.join(times, [by, "particle"], "left_anti").select(by, "particle").withColumn("k", F.row_number().over(w))
    moved = free.join(extra, [by, "k"]).select(by, "particle", "source")
    return times.select(by, "particle", F.col("particle").alias("source")).union(moved)
