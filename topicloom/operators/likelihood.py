"""Held-out likelihoods given a topic model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.rng import generator
from topicloom.operators.counts import topic_model, unseen_phi
from topicloom.operators.gibbs import counted
from topicloom.operators.lanes import FEW_TOPICS, columns, dealt
from topicloom.sources.scratch import by_group


def with_phi(tokens: DataFrame, counts: DataFrame, num_topics: int, vocab_size: int, beta: float) -> DataFrame:
    """(doc_id, phis): each document's word probabilities by topic, in order."""
    none = F.array(*map(F.lit, unseen_phi(counts, num_topics, vocab_size, beta)))
    rows = tokens.join(topic_model(counts, num_topics, vocab_size, beta), "word_id", "left").select("doc_id", "pos", F.coalesce("phi", none).alias("phi"))
    return by_group(rows, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "phi"))).alias("w")).select("doc_id", F.col("w.phi").alias("phis"))


def first_moment(docs: DataFrame, num_topics: int, alpha: float = 0.1) -> DataFrame:
    """(doc_id, ll, n): per document from zero, each word adds the log of its
    predictive probability and its posterior to fractional topic counts."""
    k_alpha = num_topics * alpha
    zero = F.array(*[F.lit(0.0)] * num_topics)
    start = F.struct(zero.alias("dt"), F.lit(0.0).alias("n"), F.lit(0.0).alias("ll"), zero.alias("x"), F.lit(0.0).alias("s"))

    def step(a, phi):
        x = F.zip_with(phi, a["dt"], lambda p, d: p * ((d + alpha) / (a["n"] + k_alpha)))
        s = F.aggregate(x, F.lit(0.0), lambda b, y: b + y)
        # the fields of one struct cannot see each other, so the posterior is added a step later
        return F.struct(x.alias("x"), s.alias("s"))

    def merge(a, phi):
        xs = step(a, phi)
        dt = F.zip_with(a["dt"], xs["x"], lambda d, y: d + y / xs["s"])
        return F.struct(dt.alias("dt"), (a["n"] + 1.0).alias("n"), (a["ll"] + F.ln(xs["s"])).alias("ll"), zero.alias("x"), F.lit(0.0).alias("s"))

    return docs.select("doc_id", F.aggregate("phis", start, merge).alias("a")).select("doc_id", F.col("a.ll").alias("ll"), F.col("a.n").cast("long").alias("n"))


def first_moment_arrow(docs: DataFrame, num_topics: int, alpha: float = 0.1) -> DataFrame:
    """The same numbers from Arrow batches: for models with many topics, where
    vectors beat interpreted lambdas."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, phis in zip(batch["doc_id"], batch["phis"], strict=True):
                dt, ll = np.zeros(num_topics), 0.0
                for n, phi in enumerate(phis):
                    x = phi * ((dt + alpha) / (n + num_topics * alpha))
                    s = x.sum()
                    ll += np.log(s)
                    dt += x / s
                out.append((doc, ll, len(phis)))
            yield pd.DataFrame(out, columns=["doc_id", "ll", "n"])

    return docs.mapInPandas(kernel, "doc_id bigint, ll double, n bigint")


def sent_model(counts: DataFrame, num_topics: int, vocab_size: int, beta: float, max_model_mb: int = 512):
    """Word probabilities by topic (words x topics), broadcast behind a check of
    their size; a larger model raises, and ``with_phi`` joins it."""
    tw = counted(counts, num_topics, vocab_size, max_model_mb)
    return counts.sparkSession.sparkContext.broadcast((tw + beta) / (tw.sum(0) + vocab_size * beta))


def document_lls(docs: Sequence[np.ndarray], phi: np.ndarray, num_topics: int, alpha: float, lanes: Iterable[tuple] | None = None) -> np.ndarray:
    """The first-moment likelihoods of documents of word ids; ``lanes`` are the documents
    dealt and put in columns before, for many models."""
    out, k_alpha = np.zeros(len(docs)), num_topics * alpha
    if lanes is None:
        lanes = ((group, longer, columns(docs, group, len(longer))) for group, longer in dealt([len(d) for d in docs]))
    by_topic = list(np.ascontiguousarray(phi.T)) if num_topics < FEW_TOPICS else []
    for group, longer, words in lanes:
        ll = np.zeros(len(group))
        if by_topic:
            dt = np.full((num_topics, len(group)), alpha)
            for n, b in enumerate(longer.tolist()):
                w, own = words[n, :b], dt[:, :b]
                x = [p.take(w) for p in by_topic]
                for one, d in zip(x, own, strict=True):
                    one *= d
                s = x[0].copy()
                for one in x[1:]:
                    s += one
                ll[:b] += np.log(s / (n + k_alpha))
                for one, d in zip(x, own, strict=True):
                    one /= s
                    d += one
            out[group] = ll
            continue
        dt = np.full((len(group), num_topics), alpha)
        for n, b in enumerate(longer.tolist()):
            x = phi[words[n, :b]]
            x *= dt[:b]
            s = x.sum(1)
            ll[:b] += np.log(s / (n + k_alpha))
            x /= s[:, None]
            dt[:b] += x
        out[group] = ll
    return out


def first_moment_docs(docs: DataFrame, phi, num_topics: int, alpha: float = 0.1) -> DataFrame:
    """(doc_id, ll, n) of documents (doc_id, word_ids) and a model of
    ``sent_model``: words move as ids, and nothing is shuffled."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["word_ids"].tolist()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ll": document_lls(words, phi.value, num_topics, alpha), "n": [len(w) for w in words]})

    return docs.select("doc_id", "word_ids").mapInPandas(kernel, "doc_id bigint, ll double, n bigint")


def particles_lls(docs: Sequence[np.ndarray], num_topics: int, alpha: float, particles: int, rngs: Sequence[np.random.Generator]) -> np.ndarray:
    """The left-to-right likelihoods of documents, each by its words' phi, with a
    generator of its own. Particles of all documents of like length go together."""
    out, k_alpha = np.zeros(len(docs)), num_topics * alpha
    for group, longer in dealt([len(d) for d in docs], max(1, (1 << 20) // particles)):
        phi = np.zeros((len(longer), num_topics, len(group), 1))
        for c, d in enumerate(group.tolist()):
            phi[: len(docs[d]), :, c, 0] = docs[d]
        size = len(group) * particles
        z, dt, ll = np.zeros((len(longer), len(group), particles), np.int64), np.zeros((num_topics, len(group), particles)), np.zeros(len(group))
        flat, lane = dt.reshape(-1), np.arange(size).reshape(len(group), particles)
        for j, b in enumerate(longer.tolist()):
            draws = np.empty((j + 1, b, particles))
            for c, d in enumerate(group[:b].tolist()):
                draws[:, c] = rngs[d].random((j + 1, particles))
            for i in range(j + 1):
                if i < j:
                    flat[z[i, :b] * size + lane[:b]] -= 1
                c = dt[:, :b] + alpha
                c *= phi[i, :, :b]
                if i == j:
                    c /= j + k_alpha
                for k in range(1, num_topics):
                    c[k] += c[k - 1]
                if i == j:
                    ll[:b] += np.log(c[-1].mean(1))
                z[i, :b] = (c[:-1] <= draws[i] * c[-1]).sum(0)
                flat[z[i, :b] * size + lane[:b]] += 1
        out[group] = ll
    return out


def left_to_right(docs: DataFrame, num_topics: int, alpha: float = 0.1, particles: int = 20, seed: int = 0) -> DataFrame:
    """(doc_id, ll, n): per position, particles resample the topics of earlier
    positions, sum the predictive probabilities and draw a topic. Quadratic in a
    document's length, documents are independent; particles go together."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            phi, ends = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, num_topics), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            held = [phi[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lls = particles_lls(held, num_topics, alpha, particles, [generator(seed, "ltr", int(d)) for d in ids])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lls), pa.array(np.diff(ends), pa.int64())], names=["doc_id", "ll", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "phis").mapInArrow(kernel, "doc_id bigint, ll double, n bigint")


def perplexity(lls: DataFrame) -> DataFrame:
    """(ll, n, perplexity); null without tokens."""
    sums = lls.agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"))
    return sums.select("ll", "n", F.exp(-F.col("ll") / F.nullif("n", F.lit(0))).alias("perplexity"))
