"""Model-parallel sweeps and draws in constant time."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions.rng import generator
from topicloom.operators import rotation
from topicloom.sources import corpus
from topicloom.sources.scratch import keep


def corpus_of(spark, n=120, topics=4, vocab=60, words=40):
    docs = corpus.generate_corpus(spark, n, words, topics, vocab, seed=3)
    return keep(docs.select("doc_id", "category", F.transform("tokens", lambda t: t.cast("int")).alias("word_ids")), "docs"), vocab


def rows(df):
    return {r.doc_id: (list(r.word_ids), list(r.topics)) for r in df.collect()}


def test_alias_table():
    rng = np.random.default_rng(1)
    for weights in ([1.0], [0.0, 3.0, 1.0], rng.random(50).tolist(), (rng.random(200) ** 8).tolist()):
        alias, n = rotation.Alias(weights), len(weights)
        mass = np.zeros(n)  # what each topic gets of all columns
        for k in range(n):
            mass[k] += alias.share[k] / n
            mass[alias.other[k]] += (1 - alias.share[k]) / n
        assert mass == pytest.approx(np.array(weights) / sum(weights), abs=1e-12)
        assert {alias.draw(u) for u in (0.0, 0.5, 1 - 1e-12)} <= set(range(n))


@pytest.mark.parametrize("sparse", [False, True])
def test_draws_follow_the_posterior(sparse):
    """A chi-square test of one token's topic against the dense posterior, with an
    alias table that is out of date."""
    rng = random.Random(2)
    k, vocab = 12, 30
    model = rotation.Slice(k, vocab, 0.3, 0.1, [rng.randrange(20, 200) for _ in range(k)], steps=3)
    model.add(0, list(range(k)), [rng.choice([0, 0, 1, 5, 20]) for _ in range(k)])
    old = model.table(0)
    for z in range(k):  # counts go on, the table stays
        model.rows[0][z] += rng.choice([0, 0, 7])
        model.t[z] += 30
    topics = [rng.randrange(k // 2) for _ in range(15)]
    j, n = 4, 40000
    counts = {z: sum(x == z for i, x in enumerate(topics) if i != j) for z in set(topics)}
    counts = {z: c for z, c in counts.items() if c}
    want = rotation.posterior(model.rows[0], model.t, [counts.get(z, 0) for z in range(k)], 0.3, 0.1, vocab)
    draws = iter(np.random.default_rng(3).random(n * 16).tolist())
    seen, z = [0] * k, topics[j]
    for _ in range(n):
        model.tables[0] = (old, 0)
        z = model.stepped(0, z, j, topics, counts, draws) if sparse else model.dense(0, counts, next(draws))
        seen[z] += 1
    # steps of a chain depend on each other a little: the bound is that of 11 degrees of freedom at 1e-6, doubled
    chi = sum((s - n * p) ** 2 / (n * p) for s, p in zip(seen, want, strict=True))
    assert chi < (100 if sparse else 50), (chi, seen, [n * p for p in want])


def test_time_of_a_token_grows_slower_than_topics():
    def seconds(k, sparse):
        rng = random.Random(1)
        model = rotation.Slice(k, 500, 0.1, 0.1, [1000] * k)
        for w in range(20):
            model.add(w, list(range(k)), [rng.randrange(5) for _ in range(k)])
        words = [rng.randrange(20) for _ in range(3000)]
        topics = [rng.randrange(k) for _ in words]
        for w, z in zip(words, topics, strict=True):
            model.rows[w][z] += 1
        began = time.process_time()
        model.sweep(words, topics, list(range(len(words))), np.random.default_rng(1), sparse)
        return time.process_time() - began

    assert seconds(1600, True) < 4 * seconds(100, True)
    assert seconds(1600, True) < 0.5 * seconds(1600, False)


def test_one_block_is_the_exact_chain(spark):
    docs, vocab = corpus_of(spark, 30)
    found = rows(rotation.rotating_gibbs(docs, keep, vocab, 4, iters=2, seed=5, blocks=1, sparse=False))
    held = {r.doc_id: list(r.word_ids) for r in docs.collect()}
    topics = {d: generator(5, "start", d).integers(0, 4, len(w)).tolist() for d, w in held.items()}
    tw, t = np.zeros((vocab, 4), int), np.zeros(4, int)
    for d, w in held.items():
        np.add.at(tw, (w, topics[d]), 1)
        np.add.at(t, topics[d], 1)
    for k in range(2):
        for d in sorted(held):
            u = generator(5, f"rotate{k}.0", d).random(len(held[d]))
            for j, w in enumerate(held[d]):
                z = topics[d][j]
                tw[w, z] -= 1
                t[z] -= 1
                own = np.bincount([x for i, x in enumerate(topics[d]) if i != j], minlength=4)
                c = np.cumsum((tw[w] + 0.1) / (t + vocab * 0.1) * (own + 0.1))
                z = topics[d][j] = int(min((c <= u[j] * c[-1]).sum(), 3))
                tw[w, z] += 1
                t[z] += 1
    assert found == {d: (held[d], topics[d]) for d in held}


@pytest.mark.parametrize("blocks, sparse", [(3, False), (4, True)])
def test_rotation_learns_and_counts_stay_whole(spark, blocks, sparse):
    docs, vocab = corpus_of(spark)
    more = docs.select("doc_id", "word_ids").union(spark.createDataFrame([(10**6, [])], "doc_id long, word_ids array<int>"))
    kept = []

    def held(df, name):
        kept.append(keep(df, name))
        return kept[-1]

    found = rows(rotation.rotating_gibbs(more, held, vocab, 4, iters=12, seed=1, blocks=blocks, sparse=sparse))
    assert found.pop(10**6) == ([], [])
    words = {r.doc_id: list(r.word_ids) for r in docs.collect()}
    assert {d: w for d, (w, _) in found.items()} == words
    # the model of the last round is what the assignments count, and each word stands in one slice
    cells = {}
    for w, z in found.values():
        for pair in zip(w, z, strict=True):
            cells[pair] = cells.get(pair, 0) + 1
    model = kept[-1].where("kind = 0").collect()
    assert {(r.id, z): n for r in model for z, n in zip(r.a, r.b, strict=True)} == cells and len({r.id for r in model}) == len(model)
    # topics are those that documents were made of
    category, agree = {r.doc_id: r.category for r in docs.collect()}, {}
    for d, (_, z) in found.items():
        agree.setdefault(category[d], []).append(max(set(z), key=z.count))
    purity = sum(max(x.count(t) for t in set(x)) for x in agree.values()) / len(category)
    assert purity > 0.8
    # the same blocks give the same result however rows are partitioned
    again = rows(rotation.rotating_gibbs(more.repartition(7), keep, vocab, 4, iters=2, seed=1, blocks=blocks, sparse=sparse))
    assert again == rows(rotation.rotating_gibbs(more.coalesce(1), keep, vocab, 4, iters=2, seed=1, blocks=blocks, sparse=sparse))


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, word_ids array<int>")
    assert rotation.rotating_gibbs(none, keep, 10, 3, iters=1, blocks=2).count() == 0


@pytest.mark.parametrize("blocks", [3, 4])
def test_each_block_has_a_task_of_its_own(spark, blocks):
    docs, vocab = corpus_of(spark)
    rounds = []

    def held(df, name):
        out = keep(df, name)
        if name.startswith("rotation_0_"):
            rounds.append({r.f for r in out.where("kind = 1").select(F.input_file_name().alias("f")).distinct().collect()})
        return out

    rotation.rotating_gibbs(docs.select("doc_id", "word_ids"), held, vocab, 4, iters=1, seed=1, blocks=blocks)
    assert [len(x) for x in rounds] == [blocks] * blocks  # a task writes one file


@pytest.mark.parametrize("steps", [1, 2])
def test_a_documents_steps_are_those_of_its_tokens(steps):
    rng, k, vocab = random.Random(4), 7, 20
    docs = [[rng.randrange(vocab) for _ in range(n)] for n in (1, 30, 12, 0, 45) * 3]
    topics = [[rng.randrange(k) for _ in d] for d in docs]

    def slice_of():
        model = rotation.Slice(k, vocab, 0.3, 0.1, [sum(z == x for d in topics for z in d) for x in range(k)], steps)
        for w in range(vocab):
            model.add(w, list(range(k)), [sum(v == w and z == x for d, t in zip(docs, topics, strict=True) for v, z in zip(d, t, strict=True)) for x in range(k)])
        return model

    together, apart = slice_of(), slice_of()
    for d, (words, z) in enumerate(zip(docs, topics, strict=True)):
        mine, own, held = [j for j in range(len(words)) if j % 3], list(z), list(z)
        together.sweep(np.array(words, np.int32), own, mine, generator(1, "x", d), True)
        draws = iter(generator(1, "x", d).random(len(mine) * 4 * steps).tolist())
        for j in mine:
            apart.rows[words[j]][held[j]] -= 1
            apart.t[held[j]] -= 1
            counts = {x: n for x in range(k) if (n := sum(y == x for i, y in enumerate(held) if i != j))}
            held[j] = apart.stepped(words[j], held[j], j, held, counts, draws)
            apart.rows[words[j]][held[j]] += 1
            apart.t[held[j]] += 1
        assert own == held and all(type(x) is int for x in own)
    assert together.t == apart.t and together.rows == apart.rows


def test_a_documents_steps_are_taken_faster():
    rng, k = random.Random(1), 100
    words, topics = [rng.randrange(20) for _ in range(4000)], [rng.randrange(k) for _ in range(4000)]
    model = rotation.Slice(k, 500, 0.1, 0.1, [1000] * k)
    for w in range(20):
        model.add(w, list(range(k)), [20 + rng.randrange(5) for _ in range(k)])

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    def apart():
        counts, draws = {x: topics.count(x) for x in range(k)}, iter(np.random.default_rng(1).random(4000 * 8).tolist())
        for j, w in enumerate(words):
            model.stepped(w, topics[j], j, topics, counts, draws)

    together = min(seconds(lambda: model.sweep(words, list(topics), list(range(4000)), np.random.default_rng(1), True)) for _ in range(3))
    assert together < 0.9 * min(seconds(apart) for _ in range(3))
