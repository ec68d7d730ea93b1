"""Collapsed Gibbs sampling: exact and sequential within a run, runs in parallel;
inference on unseen documents in parallel; and a distributed approximation."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.rng import generator
from topicloom.operators import lanes
from topicloom.operators.lanes import columns, dealt
from topicloom.sources.scratch import by_group


#: Topics up to which a sweep has a variable for each.
FEW_TOPICS = 4


class GibbsState:
    """Counts and assignments of one run. Plain lists: a token touches K numbers,
    for which they are faster than arrays."""

    def __init__(self, num_topics: int, vocab_size: int, alpha: float, beta: float):
        self.k, self.v, self.alpha, self.beta = num_topics, vocab_size, alpha, beta
        self.tw = [[0] * num_topics for _ in range(vocab_size)]  # by word, so that a token's counts lie together
        self.t = [0] * num_topics
        self.docs: list[list[int]] = []
        self.z: list[list[int]] = []
        self.dt: list[list[int]] = []

    def add_seed(self, topic: int, word: int, n: int) -> None:
        """Counts without tokens, which never leave."""
        self.tw[word][topic] += n
        self.t[topic] += n

    def start(self, docs: list[list[int]], rng: np.random.Generator, learn: bool = True) -> None:
        self.docs = docs
        self.z = [rng.integers(0, self.k, len(d)).tolist() for d in docs]
        self.dt = [[0] * self.k for _ in docs]
        for words, topics, counts in zip(docs, self.z, self.dt, strict=True):
            for w, z in zip(words, topics, strict=True):
                counts[z] += 1
                if learn:
                    self.tw[w][z] += 1
                    self.t[z] += 1

    def take(self, docs: list[list[int]], z: list[list[int]], dt: list[list[int]] | None = None) -> None:
        """Documents whose topics the model counts already, in place of those held, and
        their counts of topics, if they are known."""
        self.docs, self.z, self.dt = docs, z, dt or [[0] * self.k for _ in docs]
        for topics, counts in () if dt else zip(z, self.dt, strict=True):
            for k in topics:
                counts[k] += 1

    def sweep(self, rng: np.random.Generator, learn: bool = True, only: list[int] | None = None) -> None:
        """Each token in order leaves, draws its topic from the posterior, and
        comes back; with ``learn`` off the model stays as it is."""
        if learn and 1 < self.k <= FEW_TOPICS:
            self._sweep_few(rng, range(len(self.docs)) if only is None else only)
            return
        alpha, beta, vb, tw, t, topics = self.alpha, self.beta, self.v * self.beta, self.tw, self.t, range(self.k)
        for d in range(len(self.docs)) if only is None else only:
            words, z, dt = self.docs[d], self.z[d], self.dt[d]
            for j, (w, u) in enumerate(zip(words, rng.random(len(words)).tolist(), strict=True)):
                row, old = tw[w], z[j]
                dt[old] -= 1
                if learn:
                    row[old] -= 1
                    t[old] -= 1
                total, sums = 0.0, []
                for k in topics:
                    total += (row[k] + beta) / (t[k] + vb) * (dt[k] + alpha)
                    sums.append(total)
                u *= total
                new = 0
                while new < self.k - 1 and sums[new] <= u:
                    new += 1
                z[j] = new
                dt[new] += 1
                if learn:
                    row[new] += 1
                    t[new] += 1

    def _sweep_few(self, rng: np.random.Generator, docs: Iterable[int]) -> None:
        """The same for two to FEW_TOPICS topics, whose counts are variables: a token
        changes those of one or two. What others add up to is kept with its prior. A topic
        beyond the last has no mass."""
        k, alpha, beta, vb, tw = self.k, self.alpha, self.beta, self.v * self.beta, self.tw
        none, last, four, three = [0.0] * (FEW_TOPICS - k), k - 1, k == 4, k == 3
        r2 = r3 = 0
        t0, t1, t2, t3 = [*map(float, self.t), *none]
        q0, q1, q2, q3 = t0 + vb, t1 + vb, t2 + vb, t3 + vb
        for d in docs:
            words, z = self.docs[d], self.z[d]
            d0, d1, d2, d3 = [*map(float, self.dt[d]), *none]
            p0, p1, p2, p3 = d0 + alpha, d1 + alpha, d2 + alpha if k > 2 else 0.0, d3 + alpha if four else 0.0
            for j, (w, u, old) in enumerate(zip(words, rng.random(len(words)).tolist(), z, strict=True)):
                row = tw[w]
                if four:
                    r0, r1, r2, r3 = row
                elif three:
                    r0, r1, r2 = row
                else:
                    r0, r1 = row
                if old == 0:
                    r0 -= 1
                    t0 -= 1.0
                    d0 -= 1.0
                    q0, p0 = t0 + vb, d0 + alpha
                elif old == 1:
                    r1 -= 1
                    t1 -= 1.0
                    d1 -= 1.0
                    q1, p1 = t1 + vb, d1 + alpha
                elif old == 2:
                    r2 -= 1
                    t2 -= 1.0
                    d2 -= 1.0
                    q2, p2 = t2 + vb, d2 + alpha
                else:
                    r3 -= 1
                    t3 -= 1.0
                    d3 -= 1.0
                    q3, p3 = t3 + vb, d3 + alpha
                c0 = (r0 + beta) / q0 * p0
                c1 = c0 + (r1 + beta) / q1 * p1
                c2 = c1 + (r2 + beta) / q2 * p2
                u *= c2 + (r3 + beta) / q3 * p3 if four else c2
                if u < c0:
                    new = 0
                    t0 += 1.0
                    d0 += 1.0
                    q0, p0 = t0 + vb, d0 + alpha
                elif u < c1 or last == 1:
                    new = 1
                    t1 += 1.0
                    d1 += 1.0
                    q1, p1 = t1 + vb, d1 + alpha
                elif u < c2 or last == 2:
                    new = 2
                    t2 += 1.0
                    d2 += 1.0
                    q2, p2 = t2 + vb, d2 + alpha
                else:
                    new = 3
                    t3 += 1.0
                    d3 += 1.0
                    q3, p3 = t3 + vb, d3 + alpha
                if new != old:
                    z[j] = new
                    row[old] -= 1
                    row[new] += 1
            self.dt[d] = [int(x) for x in (d0, d1, d2, d3)[:k]]
        self.t = [int(x) for x in (t0, t1, t2, t3)[:k]]

    def labels(self) -> list[int]:
        return [max(range(self.k), key=lambda k: (c[k], -k)) if any(c) else 0 for c in self.dt]


class Spool:
    """One chain over documents that lie, with their topics, in a temporary file of the
    task: memory holds the model and a chunk of about ``chunk`` tokens, however many
    documents there are. Draws are those of a chain over all of them at once."""

    def __init__(self, state: GibbsState, seed: int, chunk: int = 1 << 19):
        self.state, self.chunk, self.file = state, chunk, tempfile.TemporaryFile()
        self.init, self.rng = generator(seed, "init"), generator(seed, "sweep")
        self.places: list[tuple[int, np.ndarray]] = []
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.new: np.ndarray | None = None  # first topics by word that the state doesn't count yet

    def add(self, words: np.ndarray) -> None:
        """The next document, which gets its first topics."""
        self.waiting.append(words)
        self.size += len(words)
        if self.size >= self.chunk or len(self.waiting) >= self.chunk:
            self.flush()

    def flush(self) -> None:
        k, sizes = self.state.k, np.array([len(d) for d in self.waiting], np.int64)
        words, z = np.concatenate(self.waiting).astype(np.int32), np.concatenate([self.init.integers(0, k, n) for n in sizes.tolist()]).astype(np.int32)
        self.new = np.zeros((self.state.v, k), np.int32) if self.new is None else self.new
        np.add.at(self.new.reshape(-1), words.astype(np.int64) * k + z, 1)
        self.places.append((self.file.seek(0, 2), sizes))
        for part in (words, z):
            self.file.write(part)
        self.waiting, self.size = [], 0

    def counted(self) -> GibbsState:
        """The state, which counts all topics given up to now."""
        if self.waiting:
            self.flush()
        if self.new is not None:
            new, self.new = self.new, None
            self.state.t = [a + b for a, b in zip(self.state.t, new.sum(0, dtype=np.int64).tolist(), strict=True)]
            for word in np.flatnonzero(new.any(1)).tolist():
                self.state.tw[word] = [a + b for a, b in zip(self.state.tw[word], new[word].tolist(), strict=True)]
        return self.state

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(lengths, words, topics) of the documents, in order."""
        if self.waiting:
            self.flush()
        for offset, sizes in self.places:
            self.file.seek(offset)
            words, z = (np.frombuffer(self.file.read(4 * int(sizes.sum())), np.int32) for _ in range(2))
            yield sizes, words, z

    def taken(self) -> Iterator[GibbsState]:
        """The state, holding one chunk after another."""
        self.counted()
        for sizes, words, z in self.chunks():
            ends, k = np.cumsum(sizes).tolist(), self.state.k
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            dt = np.bincount(np.repeat(np.arange(len(sizes)) * k, sizes) + z, minlength=len(sizes) * k).reshape(-1, k).tolist()
            self.state.take(*([x[a:b] for a, b in spans] for x in (words.tolist(), z.tolist())), dt)
            yield self.state

    def sweep(self) -> None:
        self.counted()
        for (offset, sizes), state in zip(self.places, self.taken(), strict=True):
            state.sweep(self.rng)
            self.file.seek(offset + 4 * int(sizes.sum()))
            self.file.write(np.fromiter(chain.from_iterable(state.z), np.int32, int(sizes.sum())))

    def labels(self) -> list[int]:
        return [label for state in self.taken() for label in state.labels()]


def spooled(docs: Iterable[np.ndarray], num_topics: int, vocab_size: int, alpha: float, beta: float, iters: int, seed: int, seeds: list[tuple[int, int, int]] = ()) -> Spool:
    """What ``learned`` gives, for more documents than fit."""
    state = GibbsState(num_topics, vocab_size, alpha, beta)
    for topic, word, n in seeds:
        state.add_seed(topic, word, n)
    out = Spool(state, seed)
    for words in docs:
        out.add(words)
    out.counted()
    for _ in range(iters):
        out.sweep()
    return out


def learned(docs: list[list[int]], num_topics: int, vocab_size: int, alpha: float, beta: float, iters: int, seed: int, seeds: list[tuple[int, int, int]] = ()) -> GibbsState:
    state = GibbsState(num_topics, vocab_size, alpha, beta)
    for topic, word, n in seeds:
        state.add_seed(topic, word, n)
    state.start(docs, generator(seed, "init"))
    rng = generator(seed, "sweep")
    for _ in range(iters):
        state.sweep(rng)
    return state


def inferred(words: list[int], phi: list[list[float]], num_topics: int, alpha: float, iters: int, rng: np.random.Generator) -> list[int]:
    """Topic counts of one unseen document after sweeps with the model frozen:
    phi holds each word's probability by topic. Plain floats, as in a sweep."""
    topics = range(num_topics)
    z, dt = rng.integers(0, num_topics, len(words)).tolist(), [0] * num_topics
    for k in z:
        dt[k] += 1
    for _ in range(iters):
        for j, (w, u) in enumerate(zip(words, rng.random(len(words)).tolist(), strict=True)):
            dt[z[j]] -= 1
            row, total, sums = phi[w], 0.0, []
            for k in topics:
                total += row[k] * (dt[k] + alpha)
                sums.append(total)
            u *= total
            new = 0
            while new < num_topics - 1 and sums[new] <= u:
                new += 1
            z[j] = new
            dt[new] += 1
    return dt


def drawn_for(docs: Sequence[np.ndarray], num_topics: int, iters: int, rngs: Sequence[np.random.Generator], cells: int = 1 << 18) -> Iterator[tuple]:
    """Documents dealt and put in columns, with their first topics and the draws of each
    sweep, which are the same whatever the model."""
    for group, longer in dealt([len(d) for d in docs], cells):
        own, longest = np.arange(len(group)), len(longer)
        first = columns([rngs[d].integers(0, num_topics, len(docs[d])) for d in group.tolist()], own, longest)
        draws = (columns([rngs[d].random(len(docs[d])) for d in group.tolist()], own, longest) for _ in range(iters))
        yield group, longer, columns(docs, group, longest), first, draws


def inferred_all(docs: Sequence[np.ndarray], phi: np.ndarray, num_topics: int, alpha: float, iters: int, rngs: Sequence[np.random.Generator] = (), drawn: Iterable[tuple] | None = None) -> np.ndarray:
    """What ``inferred`` gives for each of many documents of word ids; ``drawn`` is what
    ``drawn_for`` gave before, for many models."""
    out = np.zeros((len(docs), num_topics), np.int64)
    by_topic = list(np.ascontiguousarray(phi.T)) if num_topics < lanes.FEW_TOPICS else []
    for group, longer, words, first, every in drawn_for(docs, num_topics, iters, rngs) if drawn is None else drawn:
        if by_topic:
            out[group] = _inferred_few(longer, words, first, every, by_topic, alpha)
            continue
        z, dt = first.copy(), np.zeros((len(group), num_topics))
        flat, row = dt.reshape(-1), np.arange(len(group)) * num_topics
        for j, b in enumerate(longer.tolist()):
            flat[row[:b] + z[j, :b]] += 1
        for draws in every:
            for j, b in enumerate(longer.tolist()):
                flat[row[:b] + z[j, :b]] -= 1
                c = dt[:b] + alpha
                c *= phi[words[j, :b]]
                for k in range(1, num_topics):
                    c[:, k] += c[:, k - 1]
                z[j, :b] = (c[:, :-1] <= (draws[j, :b] * c[:, -1])[:, None]).sum(1)
                flat[row[:b] + z[j, :b]] += 1
        out[group] = dt
    return out


def _inferred_few(longer: np.ndarray, words: np.ndarray, first: np.ndarray, every: Iterable[np.ndarray], by_topic: list[np.ndarray], alpha: float) -> np.ndarray:
    """Counts of topics (documents x topics) of one group: a step takes one topic after
    another, each an array over the documents."""
    z, topics, steps = first.astype(np.int8), range(len(by_topic)), longer.tolist()
    held = np.arange(z.shape[1]) < longer[:, None]  # the rest fills columns up
    dt = np.array([((z == t) & held).sum(0) for t in topics], float).reshape(len(by_topic), -1)
    for draws in every:
        for j, b in enumerate(steps):
            w, old, own = words[j, :b], z[j, :b], dt[:, :b]
            sums: list[np.ndarray] = []
            for t, d in enumerate(own):
                d -= old == t
                c = d + alpha
                c *= by_topic[t].take(w)
                if t:
                    c += sums[-1]
                sums.append(c)
            u = draws[j, :b] * sums[-1]
            new = np.zeros(b, np.int8)
            for c in sums[:-1]:
                new += c <= u
            z[j, :b] = new
            for t, d in enumerate(own):
                d += new == t
    return dt.T


def swept_all(docs: Sequence[np.ndarray], topics: Sequence[np.ndarray], model: np.ndarray, totals: np.ndarray, vocab_size: int, alpha: float, beta: float, rngs: Sequence[np.random.Generator]) -> list[np.ndarray]:
    """The topics after a ``GibbsState.sweep`` of each of many documents, which meets the
    counts (words x topics, and all words') and its own changes alone: documents go side
    by side, with copies of their own words' rows."""
    k = model.shape[1]
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(docs)
    for group, longer in dealt([len(d) for d in docs], min(1 << 20, max(1, (1 << 22) // k))):
        longest, own = len(longer), np.arange(len(group))
        sizes = [len(docs[d]) for d in group.tolist()]
        if sum(sizes) < 16 * longest:  # a step of arrays takes as long as some 16 tokens one by one
            for d in group.tolist():
                one, mine = GibbsState(k, 0, alpha, beta), np.unique(docs[d])
                one.v, one.t, one.tw = vocab_size, totals.tolist(), dict(zip(mine.tolist(), model[mine].tolist(), strict=True))
                one.take([docs[d].tolist()], [topics[d].tolist()])
                one.sweep(rngs[d])
                out[d] = np.array(one.z[0], np.int32)
            continue
        z = columns(topics, group, longest).astype(np.int64)
        of, words = np.repeat(own, sizes), np.concatenate([docs[d] for d in group.tolist()]).astype(np.int64)
        held, at = np.unique(of * len(model) + words, return_inverse=True)
        tw, ends = model[held % max(1, len(model))].astype(float), np.cumsum(sizes).tolist()
        places = columns([at[e - n : e] for e, n in zip(ends, sizes, strict=True)], own, longest) if longest else None
        draws = columns([rngs[d].random(len(docs[d])) for d in group.tolist()], own, longest) if longest else None
        dt = np.bincount(of * k + np.concatenate([topics[d] for d in group.tolist()]).astype(np.int64), minlength=len(group) * k).astype(float)
        t, row = np.tile(totals.astype(float), len(group)), own * k
        for j, b in enumerate(longer.tolist()):
            cells, mine = places[j, :b] * k, row[:b] + z[j, :b]
            tw.reshape(-1)[cells + z[j, :b]] -= 1
            t[mine] -= 1
            dt[mine] -= 1
            p = tw[places[j, :b]]
            p += beta
            p /= t[: b * k].reshape(b, k) + vocab_size * beta
            p *= dt[: b * k].reshape(b, k) + alpha
            for c in range(1, k):
                p[:, c] += p[:, c - 1]
            z[j, :b] = (p[:, :-1] <= (draws[j, :b] * p[:, -1])[:, None]).sum(1)
            mine = row[:b] + z[j, :b]
            tw.reshape(-1)[cells + z[j, :b]] += 1
            t[mine] += 1
            dt[mine] += 1
        for c, d in enumerate(group.tolist()):
            out[d] = z[: sizes[c], c].astype(np.int32)
    return out


ASSIGNED = "run_id string, doc_id bigint, word_ids array<int>, topics array<int>"


def gibbs_runs(docs: DataFrame, vocab_size: int, num_topics: int = 3, alpha: float = 0.1, beta: float = 0.1, iters: int = 100) -> DataFrame:
    """ASSIGNED rows for documents (run_id, seed, doc_id, word_ids): every run is
    sampled exactly, in the order of doc_id, by one task. A run is one Markov chain,
    so its time is that of one core; its documents come in batches and lie in a file
    (``Spool``). ``distributed_gibbs`` spreads a corpus over tasks."""

    def sampled(run: str, spool: Spool, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for _ in range(iters):
            spool.sweep()
        ids, at = np.concatenate(ids), 0
        for sizes, words, z in spool.chunks():
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (words, z)]
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(sizes), pa.string()), pa.array(ids[at : at + len(sizes)], pa.int64()), *lists], names=["run_id", "doc_id", "word_ids", "topics"])
            at += len(sizes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, spool, ids = None, None, []
        for batch in batches:
            runs, words = batch.column(0).to_pylist(), batch.column(3)
            flat, offsets = words.values.to_numpy(), words.offsets.to_numpy()
            at = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1])]
            for a, b in zip(at, [*at[1:], len(runs)], strict=True):
                if spool is None or runs[a] != run:
                    if spool:
                        yield from sampled(run, spool, ids)
                    run, ids = runs[a], []
                    spool = Spool(GibbsState(num_topics, vocab_size, alpha, beta), batch.column(1)[a].as_py())
                ids.append(batch.column(2)[a:b].to_numpy())
                for i in range(a, b):
                    spool.add(flat[offsets[i] : offsets[i + 1]])
        if spool:
            yield from sampled(run, spool, ids)

    rows = docs.select(F.col("run_id").cast("string").alias("run_id"), F.col("seed").cast("long").alias("seed"), F.col("doc_id").cast("long").alias("doc_id"), F.col("word_ids").cast("array<int>").alias("word_ids"))
    return by_group(rows, "run_id").sortWithinPartitions("run_id", "doc_id").mapInArrow(kernel, ASSIGNED)


def assignments(runs: DataFrame) -> DataFrame:
    """ASSIGNED rows as one row (run_id, doc_id, pos, word_id, topic) a token."""
    return runs.select("run_id", "doc_id", F.posexplode(F.arrays_zip("word_ids", "topics")).alias("pos", "a")).select("run_id", "doc_id", "pos", F.col("a.word_ids").alias("word_id"), F.col("a.topics").alias("topic"))


def infer(docs: DataFrame, num_topics: int, alpha: float = 0.1, iters: int = 5, seed: int = 0) -> DataFrame:
    """(doc_id, topic, dt): Gibbs on unseen documents (doc_id, phis) with the model
    frozen: documents are independent, so this is exact and parallel."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, phis in zip(batch["doc_id"], batch["phis"], strict=True):
                dt = inferred(range(len(phis)), [list(x) for x in phis], num_topics, alpha, iters, generator(seed, "infer", int(doc)))
                out.append((doc, int(np.argmax(dt)), dt))
            yield pd.DataFrame(out, columns=["doc_id", "topic", "dt"])

    return docs.select("doc_id", "phis").mapInPandas(kernel, "doc_id bigint, topic int, dt array<bigint>")


def infer_docs(docs: DataFrame, phi, num_topics: int, alpha: float = 0.1, iters: int = 5, seed: int = 0) -> DataFrame:
    """The same for documents (doc_id, word_ids) and a model of
    ``likelihood.sent_model``: words move as ids, and nothing is shuffled."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dt = inferred_all(batch["word_ids"].tolist(), phi.value, num_topics, alpha, iters, [generator(seed, "infer", int(doc)) for doc in batch["doc_id"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "topic": dt.argmax(1), "dt": list(dt)})

    return docs.select("doc_id", "word_ids").mapInPandas(kernel, "doc_id bigint, topic int, dt array<bigint>")


def counted(counts: DataFrame, num_topics: int, vocab_size: int, max_model_mb: int) -> np.ndarray:
    """Words x topics of cells (topic, word_id, n) on the driver. Cells come in
    columns of 16 bytes; a model whose cells or matrix could take more than
    ``max_model_mb`` raises."""
    if 16 * num_topics * vocab_size > max_model_mb << 20:
        raise ValueError("the model is too large to send; use the joined form")
    table = counts.select(F.col("topic").cast("int"), F.col("word_id").cast("int"), F.col("n").cast("long")).toArrow()
    out = np.zeros((vocab_size, num_topics), np.int64)
    np.add.at(out, (table.column(1).to_numpy(), table.column(0).to_numpy()), table.column(2).to_numpy())
    return out


def distributed_gibbs(docs: DataFrame, keep, vocab_size: int, num_topics: int, alpha: float = 0.1, beta: float = 0.1, iters: int = 20, seed: int = 0, max_model_mb: int = 512) -> DataFrame:
    """(doc_id, word_ids, topics) after ``iters`` rounds in which every document
    is swept against the counts of the round before and its own changes; then
    counts are summed. An approximation of the exact chain that is the same
    however documents are partitioned. ``keep(df, name)`` writes a table and reads
    it back, which cuts lineage. The model is sent to the tasks (K * V counts);
    beyond ``max_model_mb`` this raises, and ``rotation.rotating_gibbs`` is the way."""
    if 16 * num_topics * vocab_size > max_model_mb << 20:
        raise ValueError("the model is too large to send; use rotation.rotating_gibbs")
    spark = docs.sparkSession

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["topics"] = [generator(seed, "start", int(d)).integers(0, num_topics, len(w)).tolist() for d, w in zip(batch["doc_id"], batch["word_ids"], strict=True)]
            yield batch

    schema = "doc_id bigint, word_ids array<int>, topics array<int>"
    state = keep(docs.select("doc_id", "word_ids").mapInPandas(first, schema), "sweep_0")
    for k in range(iters):
        tokens = state.select(F.explode(F.arrays_zip("word_ids", "topics")).alias("a")).select(F.col("a.word_ids").alias("word_id"), F.col("a.topics").alias("topic"))
        sent = spark.sparkContext.broadcast(counted(tokens.groupBy("word_id", "topic").agg(F.count("*").alias("n")), num_topics, vocab_size, max_model_mb))

        def sweep(batches: Iterator[pd.DataFrame], k: int = k, sent=sent) -> Iterator[pd.DataFrame]:
            totals = sent.value.sum(0)
            for batch in batches:
                rngs = [generator(seed, f"sweep{k}", int(doc)) for doc in batch["doc_id"]]
                batch["topics"] = swept_all(batch["word_ids"].tolist(), batch["topics"].tolist(), sent.value, totals, vocab_size, alpha, beta, rngs)
                yield batch

        state = keep(state.mapInPandas(sweep, schema), f"sweep_{k + 1}")
        sent.unpersist()
    return state
