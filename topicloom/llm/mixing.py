"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent t and normalised. t is bisected
between 0 (equal weights) and 1 (natural shares): the weights become as even as
the target entropy asks for and the repetition limit allows. Weights become
whole passes and one budgeted part pass over blocks of permuted documents.
All steps are DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch

#: Words, as counted for shares and budgets.
WORD = r"[^\x20\x09-\x0D]+"


def _unit(key: F.Column, seed: int) -> F.Column:
    """A number in [0, 1) from the key's md5, alike in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def temperature(shares: F.Column, entropy_gain: float, max_repeats: float, rounds: int = 40) -> F.Column:
    """The exponent for an array of positive shares.

    The target entropy lies ``entropy_gain`` of the way from that of the shares
    to the largest possible. The budget is such that no source gets less than
    one pass; the most repeated source may get ``max_repeats`` passes.
    """

    def weights(t):
        raised = F.transform(shares, lambda p: F.pow(p, t))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raised, lambda x: x / total)

    def entropy(w):
        return F.aggregate(w, F.lit(0.0), lambda a, x: a - x * F.ln(x))

    def too_even(t):
        """Whether t is below the limit: more even than asked for, or than repeats allow."""
        goal = entropy(shares) + F.lit(float(entropy_gain)) * (F.ln(F.size(shares).cast("double")) - entropy(shares))
        passes = F.transform(F.arrays_zip(weights(t).alias("w"), shares.alias("p")), lambda x: x["w"] / x["p"])
        return (entropy(weights(t)) > goal) | (F.array_max(passes) / F.array_min(passes) > F.lit(float(max_repeats)))

    def halve(a, _):
        mid = (a["low"] + a["high"]) / 2
        return F.when(too_even(mid), F.struct(mid.alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), mid.alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.round(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["high"], 6)


def source_weights(sized: DataFrame, entropy_gain: float, max_repeats: float) -> DataFrame:
    """(source, tokens, docs, share, exponent, weight, passes) for each source
    with tokens. One row a source: the number of sources, not of documents."""
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")
    listed = totals.agg(F.sort_array(F.collect_list(F.struct("tokens", F.col("source").isNull().alias("none"), "source", "docs"))).alias("s"))
    # literals of one row; the null-marker sorts before the name so that a null source has a place
    one = listed.withColumn("sum", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["tokens"])).withColumn("p", F.transform("s", lambda x: x["tokens"] / F.col("sum")))
    one = one.withColumn("exponent", temperature(F.col("p"), entropy_gain, max_repeats))
    one = one.withColumn("r", F.transform("p", lambda p: F.pow(p, F.col("exponent")))).withColumn("rs", F.aggregate("r", F.lit(0.0), lambda a, x: a + x))
    rows = one.select("exponent", F.explode(F.arrays_zip("s", "p", F.transform("r", lambda x: x / F.col("rs")).alias("w"))).alias("z"), F.array_min(F.transform(F.arrays_zip("r", "p"), lambda x: x["r"] / x["p"])).alias("least"), "rs")
    # passes of a source: its weight over its share, over the least such ratio
    return rows.select(F.col("z.s.source").alias("source"), F.col("z.s.tokens").alias("tokens"), F.col("z.s.docs").alias("docs"), F.col("z.p").alias("share"), "exponent", F.col("z.w").alias("weight"), F.round(F.col("z.w") * F.col("rs") / F.col("z.p") / F.col("least"), 6).alias("passes"))


def mix_sources(docs: DataFrame, scratch: Scratch, entropy_gain: float = 0.5, max_repeats: float = 4.0, block_docs: int = 1024, seed: int = 5) -> DataFrame:
    """(doc_id, source, n_tokens, weight, passes, block, copies, text_key) for
    every row; text_key tells rows apart that repeat a doc_id.

    Each source is a permutation of its documents by hashed id, cut into blocks
    of about ``block_docs``. Every document gets the whole passes of its source;
    the part pass takes documents in permuted order up to its token budget, so
    at most one document a source goes over. No source gets less than one pass.
    A null source is a source; rows without an id are permuted by their texts;
    null and empty texts have no tokens, and come as often as others of their
    source; every document of a source without tokens has one copy. Rows that repeat a doc_id get copies each, in the order
    of their sizes. Words are counted once and written. Extra columns are not
    read, and an empty table gives an empty result.
    """
    sized = scratch.keep(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("text").alias("text_key")), "sized")
    plan = source_weights(sized, entropy_gain, max_repeats).select(F.col("source").alias("_source"), "tokens", "docs", "weight", "passes")
    plan = scratch.keep(plan, "plan")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    unit = _unit(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_key").cast("string"))), seed)
    rows = rows.select("doc_id", "source", "n_tokens", "text_key", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(1.0)).alias("passes"), F.coalesce("tokens", F.lit(0)).alias("tokens"), unit.alias("u"), F.ceil(F.coalesce("docs", F.lit(1)) / F.lit(block_docs)).alias("blocks"))
    rows = rows.withColumn("block", F.floor(F.col("u") * F.col("blocks")))
    # sums of blocks, added up in groups of blocks first, so that no task holds all blocks of a source; then the order within a block, whose size is bounded
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block")).withColumn("group", F.floor(F.col("block") / F.lit(block_docs)))
    sums = scratch.keep(sums, "blocks")
    groups = sums.groupBy("source", "group").agg(F.sum("in_block").alias("in_group"))
    far = groups.select(F.col("source").alias("_s"), F.col("group").alias("_g"), (F.sum("in_group").over(Window.partitionBy("source").orderBy("group")) - F.col("in_group")).alias("before"))
    near = sums.withColumn("beside", F.sum("in_block").over(Window.partitionBy("source", "group").orderBy("block")) - F.col("in_block"))
    ahead = near.join(far, F.col("source").eqNullSafe(F.col("_s")) & (F.col("group") == F.col("_g"))).select(F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("before") + F.col("beside")).alias("ahead"))
    inside = rows.withColumn("so_far", F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("u", "doc_id", "n_tokens", "text_key").rowsBetween(Window.unboundedPreceding, -1)))
    placed = inside.join(ahead, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    whole = F.floor("passes")
    budget = (F.col("passes") - whole) * F.col("tokens")
    part = (F.col("ahead") + F.coalesce("so_far", F.lit(0))) < budget
    return placed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "passes", F.col("block").cast("long").alias("block"), (whole + part.cast("long")).cast("long").alias("copies"), "text_key")


def expand(docs: DataFrame, mixed: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``docs``, each as often as ``mixed`` says for its doc_id, source
    and text. Rows alike in all three share what ``mixed`` says of them together,
    so as many rows leave as it has copies; rows that it does not name stay once."""
    keys = ["__m_id", "__m_source", "__m_text"]
    told = mixed.groupBy(F.col("doc_id").alias("__m_id"), F.col("source").alias("__m_source"), F.col("text_key").alias("__m_text")).agg(F.sum("copies").alias("__m_copies"), F.count("*").alias("__m_rows"))
    told = scratch.keep(told, "told")
    held = docs.select(*docs.columns, F.col("doc_id").alias("__m_own_id"), F.col("source").alias("__m_own_source"), F.xxhash64("text").alias("__m_own_text"))
    rows = held.join(told, reduce(and_, [F.col(k.replace("__m_", "__m_own_")).eqNullSafe(F.col(k)) for k in keys]), "left")
    times = F.coalesce("__m_copies", F.lit(1))
    if told.where("__m_rows > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy("__m_own_id", "__m_own_source", "__m_own_text").orderBy("__m_copies"))
        n = F.coalesce("__m_rows", F.lit(1))
        times = F.floor(times / n) + (place <= times % n).cast("int")
    rows = rows.withColumn("__m_times", times.cast("int")).where("__m_times > 0").withColumn("__m_copy", F.explode(F.sequence(F.lit(1), F.col("__m_times"))))
    return rows.select(*docs.columns)
