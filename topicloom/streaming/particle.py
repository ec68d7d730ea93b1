"""Online topic learning by a particle filter with a reservoir of past documents.

One kernel, two ways to run it: a replay of many runs in parallel, and a stream
whose state is kept per run; both can start from stored models, report alike on
the way, and can be dumped whole. Vectors run over particles; a document's tokens
are sequential by nature.
"""

from __future__ import annotations

import io
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from topicloom.functions.rng import generator
from topicloom.operators.gibbs import learned
from topicloom.sources.scratch import by_group, keep
from topicloom.streaming.reservoir import reservoir_by_key


#: Particles and topics up to which plain numbers beat vectors, which cost more to start.
FEW_PARTICLES, FEW_TOPICS = 16, 4
#: Runs up to which each is given a task by its number, beyond by a hash.
MANY_RUNS = 1000
#: Resamplings that words may lie behind before all of them are brought up.
EPOCHS = 4096


@dataclass
class Stored:
    """A document in the reservoir: its words, every particle's topics, its category
    and whether it is an initial one."""

    doc_id: int
    words: np.ndarray
    z: np.ndarray
    about: tuple[str, bool] = ("", False)
    counted: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False, compare=False)  # topics, and their counts, as last asked for

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counted": None}


def nmi(labels: list, topics: list) -> float:
    """2 I / (H1 + H2), 0 where both entropies are."""
    return nmi_of(Counter(zip(map(str, labels), topics, strict=True)))


def nmi_of(cells: dict[tuple[str, int], float]) -> float:
    """The same from the number of documents of each (label, topic)."""
    cells = {k: n for k, n in cells.items() if n}
    if not cells:
        return 0.0
    a, x = np.unique(np.array([k[0] for k in cells], str), return_inverse=True)
    b, y = np.unique(np.array([k[1] for k in cells]), return_inverse=True)
    c = np.zeros((len(a), len(b)))
    np.add.at(c, (x, y), list(cells.values()))
    c /= c.sum()
    p, q = c.sum(1), c.sum(0)
    h = -(p * np.log(p)).sum() - (q * np.log(q)).sum()
    i, j = np.nonzero(c)
    return float(2 * (c[i, j] * np.log(c[i, j] / (p[i] * q[j]))).sum() / h) if h > 0 else 0.0


class Labels:
    """Every particle's label of every document.

    A label stands as it was given, with the number of resamplings before; which
    of the labels a particle has now is told by its ancestors. So resampling
    copies nothing. Once all particles have one ancestor, the labels given up to
    then can't differ any more and are settled.
    """

    def __init__(self, particles: int):
        self.particles, self.first = particles, 0  # the version before the first known resampling
        self.sources: list[np.ndarray] = []
        self.open: dict[int, tuple[int, np.ndarray]] = {}
        self.given: set[int] = set()
        self.settled: dict[int, int] = {}

    @property
    def version(self) -> int:
        return self.first + len(self.sources)

    def resampled(self, source: np.ndarray) -> None:
        self.sources.append(source)

    def give(self, doc: int, labels: np.ndarray) -> None:
        self.settled.pop(doc, None)
        self.open[doc] = (self.version, labels)
        self.given.add(doc)

    def ancestors(self, particle: int) -> np.ndarray:
        """Of a particle, at each version from the first known one on."""
        out = np.empty(len(self.sources) + 1, np.int64)
        out[-1] = particle
        for k in range(len(self.sources) - 1, -1, -1):
            out[k] = self.sources[k][out[k + 1]]
        return out

    def of(self, particle: int, docs: Iterable[int] | None = None) -> dict[int, int]:
        at = self.ancestors(particle)
        held = self.open if docs is None else {d: self.open[d] for d in docs if d in self.open}
        out = {d: int(x[at[v - self.first]]) for d, (v, x) in held.items()}
        return out if docs is not None else self.settled | out

    def settle(self) -> dict[int, int]:
        """Labels that no longer differ between particles; they leave the open ones."""
        every, k = np.arange(self.particles), len(self.sources)
        while k and (every != every[0]).any():
            k -= 1
            every = self.sources[k][every]
        at, one = {}, int(every[0])
        for v in range(k, -1, -1) if (every == every[0]).all() else ():  # the one ancestor at each version up to there
            at[v + self.first] = one
            if v:
                one = int(self.sources[v - 1][one])
        out = {d: int(x[at.get(v, 0)]) for d, (v, x) in self.open.items() if v in at or (x == x[0]).all()}
        for d in out:
            del self.open[d]
        self.settled |= out
        oldest = min((v for v, _ in self.open.values()), default=self.version)
        if oldest > self.first:
            self.sources, self.first = self.sources[oldest - self.first :], oldest
        return out


class Models:
    """Every particle's counts of words and topics, by word.

    Resampling copies nothing: a word's counts stand as they were when it was last met,
    with the number of resamplings (epoch) then, and are taken from each particle's
    ancestor of that epoch when it is met again. So a step costs as much as the words of
    its documents, however large the vocabulary is."""

    def __init__(self, rows: np.ndarray):
        self.rows, n = rows, rows.shape[1]  # words x particles x topics
        self.epoch, self.open, self.at = 0, 0, np.zeros(len(rows), np.int32)
        # each particle's ancestor at every epoch; up to ``open`` all have the same one
        self.ancestors = np.tile(np.arange(n), (EPOCHS + 1, 1))

    def resampled(self, source: np.ndarray) -> None:
        if self.epoch == EPOCHS:
            self.met()
        known = self.ancestors[self.open : self.epoch + 1]
        known[:] = known[:, source]
        one = (known == known[:, :1]).all(1)
        self.open += len(one) - 1 if one.all() else int(one.argmin())
        self.epoch += 1

    def meet(self, words: np.ndarray) -> None:
        """Brings different words up to the last resampling."""
        old = words[self.at[words] != self.epoch]
        if len(old):
            self.rows[old] = self.rows[old[:, None], self.ancestors[self.at[old]]]
            self.at[old] = self.epoch

    def met(self, part: int = 1 << 16) -> np.ndarray:
        """All words, brought up."""
        if self.epoch:
            for a in range(0, len(self.rows), part):
                self.meet(np.arange(a, min(a + part, len(self.rows))))
            self.ancestors[: self.epoch + 1] = np.arange(self.rows.shape[1])
            self.epoch, self.open = 0, 0
            self.at[:] = 0
        return self.rows

    def of(self, particle: int) -> np.ndarray:
        """Words x topics of one particle."""
        return self.rows[np.arange(len(self.rows)), self.ancestors[self.at, particle]]


class ParticleFilter:
    """The filter's whole state and its step."""

    def __init__(self, params: dict, vocab_size: int, seed: int):
        self.p, self.v, self.seed = params, vocab_size, seed
        n, k = params["num_particles"], params["num_topics"]
        self.models, self.t = Models(np.zeros((vocab_size, n, k), np.int32)), np.zeros((n, k), np.int64)
        for topic, word, count in params.get("seed_topics", ()):
            self.tw[:, word, topic] += count
            self.t[:, topic] += count
        self.weights = np.full(n, 1.0 / n)
        self.reservoir: list[Stored] = []
        self.seen, self.version, self.init_docs, self.tokens = 0, 0, 0, 0
        self.labels = Labels(n)
        self.moved: set[int] = set()  # slots of the reservoir that are other than when they were last written
        self.waiting: list[tuple[int, list[int], str]] = []
        self.ready = params["init_num_docs"] <= 0
        self.evaluated = -1  # documents before the last evaluation
        self.about: dict[int, tuple[str, bool]] = {}  # of documents with open labels: category, and whether they are initial ones
        self.closed: Counter = Counter()  # (initial, category, topic) of documents whose labels can't change

    @property
    def tw(self) -> np.ndarray:
        """Every particle's counts of words and topics, particles first."""
        return self.models.met().transpose(1, 0, 2)

    # construction

    def _initialise(self) -> None:
        """Gibbs on the first documents; its model goes to all particles, its
        assignments to the reservoir, with counts that match them."""
        p = self.p
        docs = [w for _, w, _ in self.waiting]
        state = learned(docs, p["num_topics"], self.v, p["alpha"], p["beta"], p["init_num_iters"], p.get("gibbs_seed", self.seed), p.get("seed_topics", ()))
        self.tw[:], self.t[:] = np.array(state.tw, np.int32), np.array(state.t)
        self._begin([(doc, words, z, category) for (doc, words, category), z in zip(self.waiting, state.z, strict=True)])
        self.waiting = []

    def _begin(self, docs: Iterable[tuple[int, list[int], list[int], str]]) -> None:
        """Takes the initial documents with their topics, which the model counts."""
        n = len(self.weights)
        for doc, words, z, category in docs:
            stored = Stored(doc, np.array(words, np.int64), np.tile(np.array(z, np.int64), (n, 1)), (category, True))
            self._label(stored)
            self.tokens += len(words)
            self.init_docs += 1
            out = self._offer(stored)
            if self.p["forget_stats"] and out is not None:
                self._forget(out)
        self.ready = True

    @classmethod
    def started(cls, params: dict, vocab_size: int, seed: int, rows: pd.DataFrame) -> ParticleFilter:
        """From STARTS rows of a run: the model goes to all particles, the documents to
        the reservoir, in their order. Documents that are counted but not given have
        gone by before."""
        out = cls(params | {"seed_topics": ()}, vocab_size, seed)
        of = {kind: part for kind, part in rows.groupby("kind")}
        none = rows.iloc[:0]
        model, docs, gone, cells = (of.get(k, none) for k in ("model", "doc", "gone", "cell"))
        np.add.at(out.tw, (slice(None), model["word_id"].to_numpy(np.int64), model["topic"].to_numpy(np.int64)), model["n"].to_numpy(np.int32))
        out.t[:] = out.tw[0].sum(0)
        out.seen = out.init_docs = int(gone["n"].sum())
        out.tokens = int(gone["ord"].sum())
        if out.seen and len(docs) > params["reservoir_size"]:
            raise ValueError("a sample of the documents gone by must fit the reservoir")
        for r in cells.itertuples():
            out.closed[True, str(r.category), int(r.topic)] += int(r.n)
        docs = docs.sort_values(["ord", "doc_id"])
        out._begin((int(d), [int(w) for w in words], [int(z) for z in topics], str(c)) for d, words, topics, c in zip(docs["doc_id"], docs["word_ids"], docs["topics"], docs["category"], strict=True))
        return out

    def _label(self, doc: Stored) -> None:
        self.labels.give(doc.doc_id, self._dt(doc).argmax(1))
        self.about[doc.doc_id] = doc.about

    def _rng(self, purpose: str) -> np.random.Generator:
        return generator(self.seed, purpose, self.seen)

    # the reservoir: a uniform sample of documents (Algorithm R)

    def _offer(self, doc: Stored) -> Stored | None:
        """Inserts the document or not; gives back what no longer is, or never
        was, in the reservoir."""
        size = self.p["reservoir_size"]
        self.seen += 1
        if len(self.reservoir) < size:
            self.moved.add(len(self.reservoir))
            self.reservoir.append(doc)
            return None
        slot = int(self._rng("reservoir").integers(0, self.seen)) if size else 0
        if slot >= size:
            return doc
        self.moved.add(slot)
        out, self.reservoir[slot] = self.reservoir[slot], doc
        if out.doc_id not in self.labels.open:  # all particles agree on it
            self._close(out.doc_id, int(self._dt(out)[0].argmax()), out.about)
        return out

    def _close(self, doc: int, label: int, about: tuple[str, bool]) -> None:
        self.closed[(about[1], about[0], label)] += 1
        self.about.pop(doc, None)

    def settle(self) -> dict[int, int]:
        """Labels on which particles agree from now on. Those of documents outside the
        reservoir can't change any more, and are only counted."""
        out, held = self.labels.settle(), {d.doc_id for d in self.reservoir}
        for doc, label in out.items():
            if doc not in held:
                self._close(doc, label, self.about[doc])
            else:
                self.about.pop(doc, None)
        return out

    def agreement(self) -> tuple[float, float]:
        """NMI of the best particle's labels, of all documents and of the initial ones."""
        best, every, first = self.best(), Counter(), Counter()
        held = {d.doc_id for d in self.reservoir}
        at = self.labels.ancestors(best)
        found = [(d.about, int(self._dt(d)[best].argmax())) for d in self.reservoir]
        found += [(self.about[d], int(x[at[v - self.labels.first]])) for d, (v, x) in self.labels.open.items() if d not in held]
        for (initial, category, topic), n in [*self.closed.items(), *(((i, c, z), 1) for (c, i), z in found)]:
            every[category, topic] += n
            first[category, topic] += n if initial else 0
        return nmi_of(every), nmi_of(first)

    def _forget(self, doc: Stored) -> None:
        self.models.meet(np.unique(doc.words))
        np.subtract.at(self.models.rows.reshape(-1), self._cells(doc.words, doc.z).ravel(), 1)
        self.t -= self._dt(doc)

    def _dt(self, doc: Stored) -> np.ndarray:
        """Every particle's counts of a document's topics; kept as long as these stand."""
        if doc.counted is None or doc.counted[0] is not doc.z:
            n, k = len(doc.z), self.p["num_topics"]
            doc.counted = doc.z, np.bincount((doc.z + np.arange(n)[:, None] * k).ravel(), minlength=n * k).reshape(n, k)
        return doc.counted[1]

    # the step

    def step(self, doc_id: int, words: list[int], category: str = "") -> list[int]:
        """Takes one document; gives the ids whose labels were given anew."""
        if not self.ready:
            self.waiting.append((doc_id, words, category))
            if len(self.waiting) < self.p["init_num_docs"]:
                return []
            self._initialise()
            return list(self.labels.open)
        p, n, k = self.p, len(self.weights), self.p["num_topics"]
        self.tokens += len(words)
        room = np.zeros((n, len(words)), np.int64)  # topics of the tokens so far are its first columns
        doc = Stored(doc_id, np.array(words, np.int64), room[:, :0], (category, False))
        out = self._offer(doc)
        if p["forget_stats"] and out is not None and out is not doc:
            self._forget(out)
        given = {doc_id}
        if self._few() and not p["resample_per_token"]:
            room = self._propagate_few(doc.words, self._rng("propagate").random((len(words), n)))
        else:
            given |= self._propagate(doc, room)
        weights = self.weights
        doc.z = room
        weights /= weights.sum()
        if not p["resample_per_token"] and self.ess() < p["ess_threshold"]:
            given |= self._resample(doc)
        if p["forget_stats"] and out is doc:
            self._forget(doc)
        self._label(doc)
        return list(given)

    def _propagate(self, doc: Stored, room: np.ndarray) -> set[int]:
        """Every particle's topics of a new document's tokens, into ``room``; vectors run
        over particles. Gives the ids whose labels were given anew."""
        p, n, k = self.p, len(self.weights), self.p["num_topics"]
        words, given = doc.words.tolist(), set()
        # counts with their priors, kept up token by token; a particle's cell stands at row + topic, one of its model at word * n * k + row + topic
        own_words, row = np.unique(doc.words), np.arange(n) * k
        self.models.meet(own_words)
        own, all_words = np.full((n, k), p["alpha"]), self.t + self.v * p["beta"]
        flat_own, flat_all, model = own.ravel(), all_words.ravel(), self.models.rows.reshape(-1)
        tw, beta, weights, each = self.models.rows, p["beta"], self.weights, p["resample_per_token"]
        draws = self._rng("propagate").random((len(words), n))
        for j, word in enumerate(words):
            x = tw[word] + beta
            x *= own
            x /= all_words
            c = x.cumsum(1)
            mass = c[:, -1]
            weights *= mass
            if each or not j & 15:
                weights /= weights.sum()
            z = (c[:, :-1] <= (draws[j] * mass)[:, None]).sum(1)
            room[:, j] = z
            at = row + z
            flat_own[at] += 1
            flat_all[at] += 1
            model[word * n * k + at] += 1
            if each and self.ess() < p["ess_threshold"]:
                doc.z = room[:, : j + 1]
                self.t = np.rint(all_words - self.v * beta).astype(np.int64)
                given |= self._resample(doc)
                room[:, : j + 1] = doc.z
                own[:], all_words[:] = self._dt(doc) + p["alpha"], self.t + self.v * beta
                weights = self.weights
                self.models.meet(own_words)
        self.t = np.rint(all_words - self.v * beta).astype(np.int64)
        return given

    def _few(self) -> bool:
        return len(self.weights) <= FEW_PARTICLES and self.p["num_topics"] <= FEW_TOPICS

    def _plain(self, words: np.ndarray) -> tuple[list, list, list[int]]:
        """Every particle's counts of the words by topic, its totals with their priors, and
        the words' places. Topics are filled up to FEW_TOPICS with ones of no mass."""
        (own, at), n, k = np.unique(words, return_inverse=True), len(self.weights), self.p["num_topics"]
        self.models.meet(own)
        rows = np.zeros((n, FEW_TOPICS, len(own)), np.int32)
        rows[:, :k] = self.models.rows[own].transpose(1, 2, 0)
        below = np.ones((n, FEW_TOPICS))
        below[:, :k] = self.t + self.v * self.p["beta"]
        return rows.tolist(), below.tolist(), at.tolist()

    def _cells(self, words: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Places in the flat models of every particle's topics z of words."""
        n, k = len(z), self.p["num_topics"]
        return words * (n * k) + np.arange(0, n * k, k)[:, None] + z

    def _totals(self, below: list[list[float]]) -> None:
        self.t = np.rint(np.array(below)[:, : self.p["num_topics"]] - self.v * self.p["beta"]).astype(np.int64)

    def _propagate_few(self, words: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """The same topics in plain numbers. A particle's tokens go one after another, as
        particles meet in the weights alone. Counts of the document and of all words are
        variables, as a token changes one of each."""
        n, beta, last = len(self.weights), self.p["beta"], self.p["num_topics"] - 1
        rows, totals, places = self._plain(words)
        masses, room = np.empty((n, len(places))), np.empty((n, len(places)), np.int64)
        four, first = last == 3, [self.p["alpha"]] * (last + 1) + [0.0] * (FEW_TOPICS - last - 1)
        for m, own_draws in enumerate(np.ascontiguousarray(draws.T).tolist()):
            (n0, n1, n2, n3), mass, topics = rows[m], [], []
            a0, a1, a2, a3 = first
            b0, b1, b2, b3 = totals[m]
            for i, u in zip(places, own_draws, strict=True):
                c0 = (n0[i] + beta) * a0 / b0
                c1 = c0 + (n1[i] + beta) * a1 / b1
                c2 = c1 + (n2[i] + beta) * a2 / b2
                c3 = c2 + (n3[i] + beta) * a3 / b3 if four else c2
                mass.append(c3)
                u *= c3
                if u < c0 or not last:
                    topics.append(0)
                    n0[i] += 1
                    a0 += 1.0
                    b0 += 1.0
                elif u < c1 or last == 1:
                    topics.append(1)
                    n1[i] += 1
                    a1 += 1.0
                    b1 += 1.0
                elif u < c2 or last == 2:
                    topics.append(2)
                    n2[i] += 1
                    a2 += 1.0
                    b2 += 1.0
                else:
                    topics.append(3)
                    n3[i] += 1
                    a3 += 1.0
                    b3 += 1.0
            masses[m], room[m], totals[m] = mass, topics, [b0, b1, b2, b3]
        np.add.at(self.models.rows.reshape(-1), self._cells(words, room).ravel(), 1)
        self._totals(totals)
        self._weigh(np.ascontiguousarray(masses.T))
        return room

    def _weigh(self, masses: np.ndarray) -> None:
        """Weights times the masses of tokens (rows) one after another, brought to a sum of
        one at every sixteenth."""
        weights = self.weights
        for a in range(-15, len(masses), 16) if len(masses) else ():
            masses[max(a, 0)] *= weights
            np.multiply.reduce(masses[max(a, 0) : a + 16], axis=0, out=weights)
            if a + 15 < len(masses):
                weights /= weights.sum()

    def ess(self) -> float:
        return float(1.0 / (self.weights**2).sum())

    def _resample(self, doc: Stored) -> set[int]:
        """Multinomial resampling: picked particles keep their places, further
        picks fill the others in order; then rejuvenation, and new labels for the
        documents of the reservoir."""
        n = len(self.weights)
        rng = self._rng(f"resample{self.version}")
        picks = np.minimum(np.searchsorted(np.cumsum(self.weights), rng.random(n), "right"), n - 1)
        times = np.bincount(picks, minlength=n)
        source = np.arange(n)
        source[times == 0] = np.repeat(np.arange(n), np.maximum(times - 1, 0))
        if (source != np.arange(n)).any():
            self.models.resampled(source)
            self.t = self.t[source]
            docs = self.reservoir if any(d is doc for d in self.reservoir) else [*self.reservoir, doc]
            for d, counts in zip(docs, np.stack([self._dt(d) for d in docs])[:, source], strict=True):
                d.z = d.z[source]
                d.counted = d.z, counts
            self.moved.update(range(len(self.reservoir)))
        self.labels.resampled(source)
        self.weights = np.full(n, 1.0 / n)
        self.version += 1
        self._rejuvenate(rng)
        if self.reservoir:
            for d, label in zip(self.reservoir, np.stack([self._dt(d) for d in self.reservoir]).argmax(2), strict=True):
                self.labels.give(d.doc_id, label)
                self.about[d.doc_id] = d.about
        return {d.doc_id for d in self.reservoir}

    def _rejuvenate(self, rng: np.random.Generator) -> None:
        """Gibbs sweeps over a uniform sample of the reservoir's documents, one
        sample for all particles."""
        p, size, held = self.p, self.p["rejuv_sample_size"], len(self.reservoir)
        slots = list(range(held)) if size >= held else rng.choice(held, size, replace=False).tolist()
        self.moved.update(slots)
        if self._few():
            self._sweep_few([self.reservoir[slot] for slot in slots], rng)
        else:
            self._sweep([self.reservoir[slot] for slot in slots], rng)

    def _sweep(self, docs: list[Stored], rng: np.random.Generator) -> None:
        p = self.p
        n, k, beta = len(self.weights), p["num_topics"], p["beta"]
        row, tw, model = np.arange(n) * k, self.models.rows, self.models.rows.reshape(-1)
        if docs:
            self.models.meet(np.unique(np.concatenate([d.words for d in docs])))
        all_words = self.t + self.v * beta
        flat_all = all_words.ravel()
        for doc in docs:
            topics, own = np.ascontiguousarray(doc.z.T), self._dt(doc) + p["alpha"]
            flat_own, words = own.ravel(), doc.words.tolist()
            for _ in range(p["rejuv_mcmc_steps"]):
                draws = rng.random((len(topics), n))
                for j, word in enumerate(words[: len(topics)]):
                    at = row + topics[j]
                    flat_own[at] -= 1
                    flat_all[at] -= 1
                    model[word * n * k + at] -= 1
                    x = tw[word] + beta
                    x *= own
                    x /= all_words
                    c = x.cumsum(1)
                    z = (c[:, :-1] <= (draws[j] * c[:, -1])[:, None]).sum(1)
                    topics[j] = z
                    at = row + z
                    flat_own[at] += 1
                    flat_all[at] += 1
                    model[word * n * k + at] += 1
            doc.z = np.ascontiguousarray(topics.T)
        self.t = np.rint(all_words - self.v * beta).astype(np.int64)

    def _sweep_few(self, docs: list[Stored], rng: np.random.Generator) -> None:
        """The same in plain numbers: one particle after another goes over all documents."""
        p, n, k = self.p, len(self.weights), self.p["num_topics"]
        alpha, beta, steps = p["alpha"], p["beta"], p["rejuv_mcmc_steps"]
        if not docs:
            return
        words, was = np.concatenate([d.words[: d.z.shape[1]] for d in docs]), np.concatenate([d.z for d in docs], axis=1)
        rows, totals, places = self._plain(words)
        ends = np.cumsum([d.z.shape[1] for d in docs]).tolist()
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        own = np.zeros((n, len(docs), FEW_TOPICS))
        own[:, :, :k] = np.stack([self._dt(d) for d in docs], 1) + alpha
        # draws of a document's steps follow one another, by token
        every, z, draws = own.tolist(), was.tolist(), np.ascontiguousarray(rng.random((len(words) * steps, n)).T).tolist()
        last, four = k - 1, k == 4
        for m in range(n):
            counts = n0, n1, n2, n3 = rows[m]
            b0, b1, b2, b3 = totals[m]
            topics, uniform = z[m], draws[m]
            for (start, end), (a0, a1, a2, a3) in zip(spans, every[m], strict=True):
                held = places[start:end]
                for at in range(start * steps, end * steps, end - start or 1):
                    for j, i, u, old in zip(range(start, end), held, uniform[at : at + end - start], topics[start:end], strict=True):
                        r0 = n0[i]
                        r1 = n1[i]
                        r2 = n2[i]
                        if four:
                            r3 = n3[i]
                        if old == 0:
                            r0 -= 1
                            a0 -= 1.0
                            b0 -= 1.0
                        elif old == 1:
                            r1 -= 1
                            a1 -= 1.0
                            b1 -= 1.0
                        elif old == 2:
                            r2 -= 1
                            a2 -= 1.0
                            b2 -= 1.0
                        else:
                            r3 -= 1
                            a3 -= 1.0
                            b3 -= 1.0
                        c0 = (r0 + beta) * a0 / b0
                        c1 = c0 + (r1 + beta) * a1 / b1
                        c2 = c1 + (r2 + beta) * a2 / b2
                        u *= c2 + (r3 + beta) * a3 / b3 if four else c2
                        if u < c0 or not last:
                            new = 0
                            a0 += 1.0
                            b0 += 1.0
                        elif u < c1 or last == 1:
                            new = 1
                            a1 += 1.0
                            b1 += 1.0
                        elif u < c2 or last == 2:
                            new = 2
                            a2 += 1.0
                            b2 += 1.0
                        else:
                            new = 3
                            a3 += 1.0
                            b3 += 1.0
                        if new != old:
                            topics[j] = new
                            counts[old][i] -= 1
                            counts[new][i] += 1
            totals[m] = [b0, b1, b2, b3]
        now, model = np.array(z, np.int64).reshape(n, -1), self.models.rows.reshape(-1)
        moved = was != now
        np.subtract.at(model, self._cells(words, was)[moved], 1)
        np.add.at(model, self._cells(words, now)[moved], 1)
        for doc, (start, end) in zip(docs, spans, strict=True):
            doc.z = now[:, start:end].copy()
        self._totals(totals)

    # results

    def best(self) -> int:
        return int(self.weights.argmax())

    def finish(self) -> None:
        """A stream that ends within the initial documents is learned by Gibbs alone."""
        if not self.ready and self.waiting:
            self._initialise()

    # state as bytes: what is small, then a part for each particle, slot and waiting document

    SMALL = ("p", "v", "seed", "t", "weights", "seen", "version", "init_docs", "tokens", "ready", "evaluated", "closed")

    def small(self) -> bytes:
        """Counts of topics, weights and the ancestry of open labels."""
        return pickle.dumps({k: getattr(self, k) for k in self.SMALL} | {"first": self.labels.first, "sources": self.labels.sources})

    def particle_parts(self) -> list[bytes]:
        return [_packed(np.ascontiguousarray(x)) for x in self.tw]

    @classmethod
    def restored(cls, small: bytes, particles: list[bytes], reservoir: list[bytes], waiting: list[bytes], labels: dict[int, bytes]) -> ParticleFilter:
        out, held = cls.__new__(cls), pickle.loads(small)
        for k in cls.SMALL:
            setattr(out, k, held[k])
        out.models = Models(np.stack([np.load(io.BytesIO(x))["x"] for x in particles], axis=1))
        out.reservoir, out.waiting, out.moved = [pickle.loads(x) for x in reservoir], [pickle.loads(x) for x in waiting], set()
        out.labels = Labels(len(out.weights))
        out.labels.first, out.labels.sources = held["first"], held["sources"]
        held_labels = {d: pickle.loads(x) for d, x in labels.items()}
        out.labels.open = {d: x[:2] for d, x in held_labels.items()}
        out.about = {d: x[3] for d, x in held_labels.items()}
        return out


def _packed(x: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez_compressed(held, x=x)
    return held.getvalue()


EVENTS = "run_id string, iter bigint, metric string, value double"
LABELS = "run_id string, doc_id bigint, label int, version bigint"
COUNTS = "run_id string, iter bigint, particle int, topic int, word_id int, n bigint"
#: One row of any kind: an event, a label, a topic of an evaluated model (``changes``), a
#: cell of a particle's model, a document of the reservoir. Evaluated models come as what
#: changed against the one before: words and numbers by turns in ``ids``; ``n`` is the
#: evaluation that was told whole, from which on changes add up.
REPLAYED = "kind string, run_id string, iter bigint, metric string, value double, doc_id bigint, particle int, topic int, word_id int, n bigint, ids array<int>"


def frame(kind: str, run: str, **columns) -> pd.DataFrame:
    kinds = dict(x.split() for x in REPLAYED.split(", "))
    n = max((len(x) for x in columns.values() if isinstance(x, list | np.ndarray)), default=1)
    out = pd.DataFrame({"kind": pd.Series([kind] * n, dtype=object), "run_id": pd.Series([run] * n, dtype=object)})
    for name in list(kinds)[2:]:
        held = columns.get(name)
        held = held if isinstance(held, list | np.ndarray) else [held] * n
        # nullable integers, so that no id passes through a double
        out[name] = pd.array(held, dtype={"bigint": "Int64", "int": "Int32", "double": "Float64"}[kinds[name]]) if kinds[name] in ("bigint", "int", "double") else pd.Series(held, dtype=object)
    return out


def model_rows(run: str, k: int, particle: int, tw: np.ndarray) -> pd.DataFrame:
    """The cells of a word x topic table."""
    w, z = np.nonzero(tw)
    return frame("model", run, iter=k, particle=particle, topic=z.astype(np.int32), word_id=w.astype(np.int32), n=tw[w, z].astype(np.int64))


def change_rows(run: str, k: int, begun: int, change: np.ndarray) -> pd.DataFrame:
    """A row a topic of what changed in a word x topic table."""
    ids = []
    for z, column in enumerate(change.T):
        words = np.flatnonzero(column)
        ids.append(np.stack([words, column[words]], 1).astype(np.int32).ravel())
    return frame("changes", run, iter=k, topic=list(range(len(ids))), n=begun, ids=ids)


def through(rows: pd.DataFrame, vocab_size: int, num_topics: int) -> Iterator[tuple[str, int, np.ndarray]]:
    """(run_id, iter, words x topics) of changes (run_id, begun, iter, topic, ids), one
    after another; the table is changed at the next."""
    tw, last = np.zeros((vocab_size, num_topics), np.int64), None
    for (run, begun, k), part in rows.groupby(["run_id", "begun", "iter"], sort=True):
        if (run, begun) != last:
            last = run, begun
            tw[:] = 0
        for topic, ids in zip(part["topic"], part["ids"], strict=True):
            tw[ids[0::2], int(topic)] += ids[1::2]
        yield run, int(k), tw


class Recorder:
    """Steps a filter and tells REPLAYED rows of what happens on the way.

    Events have the number of documents before as their ``iter``: num_words and
    token (tokens before) of each document, resampling; after the initial ones,
    every ``eval_every`` and, once it is told so, all documents the NMI of all labels
    and of the initial ones (if ``labelled``) and the effective sample size, and the
    best particle's model if asked for, whole or as what changed (``change_rows``)."""

    #: Evaluations from one model that is told whole to the next.
    TOGETHER = 64

    def __init__(self, pf: ParticleFilter, run: str, eval_every: int, models: bool, labelled: bool):
        self.pf, self.run, self.eval_every, self.models, self.labelled = pf, run, eval_every, models, labelled
        self.events: list[tuple[int, str, float]] = []
        self.settled: dict[int, int] = {}  # labels that settled on the way
        self.told_model: np.ndarray | None = None  # as last told
        self.begun, self.since = 0, 0  # the last evaluation told whole, and those told from it on

    @property
    def before(self) -> int:
        return self.pf.seen + len(self.pf.waiting)

    def evaluate(self, k: int) -> Iterator[pd.DataFrame]:
        pf = self.pf
        if k == pf.evaluated:
            return
        pf.evaluated = k
        self.settled |= pf.settle()
        if self.labelled:
            every, first = pf.agreement()
            self.events += [(k, "init_in_sample_nmi", first), (k, "in_sample_nmi", every)]
        self.events.append((k, "ess", pf.ess()))
        if self.models:
            now = pf.models.of(pf.best())
            if self.told_model is None or self.since == self.TOGETHER:
                self.told_model, self.begun, self.since = np.zeros_like(now), k, 0
            yield change_rows(self.run, k, self.begun, now - self.told_model)
            self.told_model, self.since = now, self.since + 1

    def start(self) -> Iterator[pd.DataFrame]:
        """Of a filter that starts from a stored model."""
        if self.pf.ready and self.pf.seen and self.pf.evaluated < 0:
            yield from self.evaluate(self.pf.seen)

    def step(self, doc: int, words: list[int], category: str) -> Iterator[pd.DataFrame]:
        pf, k = self.pf, self.before
        was, ready = pf.version, pf.ready
        if ready:
            self.events += [(k, "num_words", len(words)), (k, "token", pf.tokens)]
        pf.step(doc, words, category)
        self.events += [(k, "resampling", 1.0)] * (pf.version - was)
        if ready and k % self.eval_every == 0:
            yield from self.evaluate(k)
        elif pf.ready and not ready:
            yield from self.evaluate(k + 1)

    def told(self) -> Iterator[pd.DataFrame]:
        if self.events:
            yield frame("event", self.run, iter=[e[0] for e in self.events], metric=[e[1] for e in self.events], value=[float(e[2]) for e in self.events])
        self.events = []

    def dump(self) -> Iterator[pd.DataFrame]:
        """All particles' models, the reservoir, documents that wait for the first
        step, and all particles' labels of documents on which they differ; on the
        others they have the emitted one."""
        pf, k = self.pf, self.before
        for p, tw in enumerate(pf.tw):
            if tw.any():
                yield model_rows(self.run, k, p, tw).assign(kind="particle")
        for doc, words, _ in pf.waiting:
            yield frame("waiting", self.run, iter=k, doc_id=doc, ids=[words])
        for d in pf.reservoir:
            yield frame("reservoir", self.run, iter=k, doc_id=d.doc_id, particle=list(range(len(d.z))), ids=[z.astype(np.int32).tolist() for z in d.z])
        for p in range(len(pf.weights)) if pf.labels.open else ():
            label = pf.labels.of(p, list(pf.labels.open))
            yield frame("particle_label", self.run, iter=k, particle=p, doc_id=list(label), topic=list(label.values()))


#: What a run starts from: cells of a model (topic, word_id, n), documents with their
#: topics in their order, documents that are counted in the model but not given (their
#: number n, and their tokens as ord), and the latter by (category, topic, n).
STARTS = "run_id string, seed bigint, kind string, topic int, word_id int, n bigint, ord bigint, doc_id bigint, category string, word_ids array<int>, topics array<int>"


def starts_from(assigned: DataFrame, params: dict) -> DataFrame:
    """STARTS rows from documents with topics (run_id, seed, ord, doc_id, category,
    word_ids, topics), whichever sampler gave them. Of a run with more documents
    than the reservoir holds, those of lowest hashed priority are in it; with
    ``forget_stats`` the model counts them alone, else all."""
    size = params["reservoir_size"]
    docs = assigned.select("run_id", F.col("seed").cast("long").alias("seed"), F.col("ord").cast("long").alias("ord"), F.col("doc_id").cast("long").alias("doc_id"), F.col("category").cast("string").alias("category"), "word_ids", "topics")
    held = reservoir_by_key(docs.select("run_id", "doc_id"), "run_id", size, "doc_id").select("run_id", "doc_id", F.lit(True).alias("held"))
    docs = keep(docs.join(held, ["run_id", "doc_id"], "left").withColumn("held", F.coalesce("held", F.lit(False))), "starts")
    counted = docs.where("held") if params["forget_stats"] else docs
    tokens = counted.select("run_id", "seed", F.explode(F.arrays_zip("word_ids", "topics")).alias("a")).select("run_id", "seed", F.col("a.topics").alias("topic"), F.col("a.word_ids").alias("word_id"))
    parts = [
        tokens.groupBy("run_id", "seed", "topic", "word_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("model")),
        docs.where("held").withColumn("kind", F.lit("doc")),
    ]
    gone = docs.where("not held")
    label = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(0), F.lit(params["num_topics"] - 1)), lambda k: F.size(F.filter("topics", lambda z: z == k))), F.array_max(F.transform(F.sequence(F.lit(0), F.lit(params["num_topics"] - 1)), lambda k: F.size(F.filter("topics", lambda z: z == k))))), F.lit(1)) - 1
    parts.append(gone.groupBy("run_id", "seed").agg(F.count("*").alias("n"), F.sum(F.size("word_ids")).alias("ord")).withColumn("kind", F.lit("gone")))
    parts.append(gone.withColumn("topic", label.cast("int")).groupBy("run_id", "seed", "category", "topic").agg(F.count("*").alias("n")).withColumn("kind", F.lit("cell")))
    for topic, word, n in params.get("seed_topics", ()):  # a parameter
        parts.append(docs.select("run_id", "seed").distinct().withColumns({"kind": F.lit("model"), "topic": F.lit(topic), "word_id": F.lit(word), "n": F.lit(n).cast("long")}))
    fields = [x.split() for x in STARTS.split(", ")]
    out = None
    for part in parts:
        part = part.select(*[(F.col(c) if c in part.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])
        out = part if out is None else out.union(part)
    return out


def replay_all(docs: DataFrame, params: dict | list[dict], vocab_size: int, eval_every: int = 50, models: bool = False, debug: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """REPLAYED rows of the filter over documents (run_id, seed, ord, doc_id,
    category, word_ids) of many runs, each in the order of ``ord`` in a task of its
    own, in one pass: those of a Recorder, the best particle's labels at the end, and
    with ``debug`` the whole state then. Runs that have STARTS rows start from them. Of a list
    of parameters, a run has those whose place stands before the slash of its id."""

    def own(run: str) -> dict:
        return params if isinstance(params, dict) else params[int(run.split("/")[0])]

    def run_of(run: str, rows: pd.DataFrame, pf: ParticleFilter, several: bool) -> Iterator[pd.DataFrame]:
        recorder = Recorder(pf, run, eval_every, models, several)
        yield from recorder.start()
        for doc, words, category in zip(rows["doc_id"], rows["word_ids"], rows["category"], strict=True):
            yield from recorder.step(int(doc), [int(w) for w in words], str(category))
        pf.finish()
        yield from recorder.evaluate(recorder.before)
        yield from recorder.told()
        label = pf.labels.of(pf.best())
        yield frame("label", run, iter=pf.version, doc_id=list(label), topic=[int(x) for x in label.values()])
        if debug:
            pf.settle()
            yield from recorder.dump()

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = list(batches)
        if not batches:
            return
        rows = pd.concat(batches).sort_values(["ord", "doc_id"])
        run = rows["run_id"].iloc[0]
        yield from run_of(run, rows, ParticleFilter(own(run), vocab_size, int(rows["seed"].iloc[0])), rows["category"].astype(str).nunique() > 1)

    def begun(key: tuple, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "doc_id"])
        seed = int((rows if len(rows) else start)["seed"].iloc[0])
        pf = ParticleFilter.started(own(key[0]), vocab_size, seed, start) if len(start) else ParticleFilter(own(key[0]), vocab_size, seed)
        names = {*rows["category"].astype(str), *start["category"].dropna().astype(str)}
        return pd.concat(list(run_of(key[0], rows, pf, len(names) > 1)))

    if starts is None:
        names = [r.run_id for r in docs.select("run_id").distinct().limit(MANY_RUNS + 1).collect()]
        if len(names) <= MANY_RUNS and None not in names:  # a hash puts two of few runs in one task, one after the other
            place = F.array_position(F.array(*map(F.lit, sorted(names))), F.col("run_id")) if names else F.lit(1)
            return docs.repartitionById(max(1, len(names)), (place - 1).cast("int")).mapInPandas(kernel, REPLAYED)
        return by_group(docs, "run_id").groupBy("run_id").applyInPandas(kernel, REPLAYED)
    return by_group(docs, "run_id").groupBy("run_id").cogroup(by_group(starts, "run_id").groupBy("run_id")).applyInPandas(begun, REPLAYED)


def events_of(replayed: DataFrame) -> DataFrame:
    return replayed.where("kind = 'event'").select("run_id", "iter", "metric", "value")


def labels_of(replayed: DataFrame) -> DataFrame:
    return replayed.where("kind = 'label'").select("run_id", "doc_id", F.col("topic").alias("label"), F.col("iter").alias("version"))


def models_of(replayed: DataFrame, kind: str = "model") -> DataFrame:
    return replayed.where(F.col("kind") == kind).select("run_id", "iter", "particle", "topic", "word_id", "n")


def changes_of(replayed: DataFrame) -> DataFrame:
    """(run_id, begun, iter, topic, ids) of evaluated models."""
    return replayed.where("kind = 'changes'").select("run_id", F.col("n").alias("begun"), "iter", "topic", "ids")


def last_models(replayed: DataFrame) -> DataFrame:
    """(run_id, topic, word_id, n) of each run's last evaluated model."""
    rows = changes_of(replayed)
    rows = rows.join(rows.groupBy("run_id").agg(F.max("begun").alias("begun")), ["run_id", "begun"])
    pairs = F.expr("transform(sequence(1, size(ids) div 2), k -> struct(ids[2 * k - 2] as word_id, ids[2 * k - 1] as n))")
    cells = rows.where(F.size("ids") > 0).select("run_id", "topic", F.explode(pairs).alias("c")).select("run_id", "topic", "c.word_id", F.col("c.n").cast("long").alias("n"))
    return cells.groupBy("run_id", "topic", "word_id").agg(F.sum("n").alias("n")).where("n <> 0")


BYTES, NUMBER, DOC = (StructType([StructField(name, kind)]) for name, kind in (("bytes", BinaryType()), ("number", IntegerType()), ("doc_id", LongType())))
#: State variables that map a number, or a document, to bytes.
MAPS = ("particles", "slots", "waiting", "labels", "starting")


def restored_filter(small: bytes | None, maps: dict[str, dict[int, bytes]], params: dict, vocab_size: int, seed: int | None = None) -> ParticleFilter:
    """A run's filter from the values of its state. A run that has met no document yet
    holds at most the rows it starts from."""
    if small is not None:
        parts = [[maps[x][k] for k in sorted(maps[x])] for x in ("particles", "slots", "waiting")]
        return ParticleFilter.restored(small, *parts, maps["labels"])
    if maps["starting"]:
        rows = pd.concat([pickle.loads(maps["starting"][k]) for k in sorted(maps["starting"])])
        return ParticleFilter.started(params, vocab_size, int(rows["seed"].iloc[0]) if seed is None else seed, rows)
    return ParticleFilter(params, vocab_size, seed or 0)


class FilterProcessor(StatefulProcessor):
    """Keeps a run's filter between micro-batches. One state value holds what is
    small (K numbers a particle, and the ancestry of labels not settled), one a
    particle its model, one a slot of the reservoir its document, one a document
    its label while particles differ on it; so no value grows with the stream. A run
    in the initial state starts from its rows, which come in parts."""

    def __init__(self, params: dict, vocab_size: int, eval_every: int = 50, models: bool = False, labelled: bool = False):
        self.params, self.vocab_size, self.how = params, vocab_size, (eval_every, models, labelled)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.small = handle.getValueState("small", BYTES)
        self.maps = {x: handle.getMapState(x, DOC if x == "labels" else NUMBER, BYTES) for x in MAPS}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = self.maps["starting"]
        held.updateValue((sum(1 for _ in held.keys()),), (pickle.dumps(initialState),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ord", "doc_id"])
        small = bytes(self.small.get()[0]) if self.small.exists() else None
        values = {x: {k[0]: bytes(v[0]) for k, v in state.iterator()} for x, state in self.maps.items()}
        emitted = {d: pickle.loads(x)[2] for d, x in values["labels"].items()}
        pf = restored_filter(small, values, self.params, self.vocab_size, int(batch["seed"].iloc[0]))
        before, was_waiting = set(emitted), len(pf.waiting)
        if small is None:
            was_waiting = 0
            for k in values["starting"]:
                self.maps["starting"].removeKey((k,))
        recorder = Recorder(pf, key[0], *self.how)
        yield from recorder.start()
        for doc, words, category in zip(batch["doc_id"], batch["word_ids"], batch["category"], strict=True):
            yield from recorder.step(int(doc), [int(w) for w in words], str(category))
        now = pf.labels.of(pf.best(), list(pf.labels.open))
        about = dict(pf.about)
        changed = {d: x for d, x in (recorder.settled | now | pf.settle()).items() if emitted.get(d) != x}
        for k, part in enumerate(pf.particle_parts()):
            self.maps["particles"].updateValue((k,), (part,))
        for k in sorted(pf.moved):
            self.maps["slots"].updateValue((k,), (pickle.dumps(pf.reservoir[k]),))
        for k in range(was_waiting, len(pf.waiting)):
            self.maps["waiting"].updateValue((k,), (pickle.dumps(pf.waiting[k]),))
        for k in range(was_waiting if not pf.waiting else 0):
            self.maps["waiting"].removeKey((k,))
        for d, (version, given) in pf.labels.open.items():
            if d in pf.labels.given or d in changed:
                self.maps["labels"].updateValue((d,), (pickle.dumps((version, given, now[d], about[d])),))
        for d in before - set(pf.labels.open):
            self.maps["labels"].removeKey((d,))
        self.small.update((pf.small(),))
        yield from recorder.told()
        if changed:
            yield frame("label", key[0], iter=pf.seen, doc_id=sorted(changed), topic=[changed[d] for d in sorted(changed)])

    def close(self) -> None:
        pass


def report_stream(docs: DataFrame, params: dict, vocab_size: int, eval_every: int = 50, models: bool = True, labelled: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """REPLAYED rows of streamed documents (run_id, seed, ord, doc_id, category,
    word_ids): what a Recorder tells, and labels of the best particle that are new or
    other than before. Needs the RocksDB state store. Within a micro-batch documents
    go in the order of ``ord``. Runs that have STARTS rows start from them."""
    processor = FilterProcessor(params, vocab_size, eval_every, models, labelled)
    initial = None if starts is None else starts.groupBy("run_id")
    return docs.groupBy("run_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=REPLAYED, outputMode="Update", timeMode="None", initialState=initial)


def filter_stream(docs: DataFrame, params: dict, vocab_size: int, starts: DataFrame | None = None) -> DataFrame:
    """LABELS updates of ``report_stream``: the latest ones are at any time what
    ``replay_all`` ends with."""
    return labels_of(report_stream(docs, params, vocab_size, models=False, starts=starts))


def stored_rows(spark: SparkSession, checkpoint: str, params: dict, vocab_size: int, eval_every: int = 50, models: bool = True, labelled: bool = False, finish: bool = False, batch: int | None = None) -> DataFrame:
    """REPLAYED rows of the state in a stream's checkpoint, live or stopped, after its
    last micro-batch or the given one: a Recorder's dump. With ``finish`` as if the
    stream ended there: also the last evaluation and the best particle's labels on
    which particles still differed. Runs are read in parallel, each in a task."""

    def state(name: str, value: str, place: str) -> DataFrame:
        reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
        reader = reader if batch is None else reader.option("batchId", batch)
        return reader.load().select(F.col("key.run_id").alias("run_id"), F.lit(name).alias("name"), F.expr(place).cast("long").alias("k"), F.col(value).alias("held"))

    rows = state("small", "value.bytes", "0")
    for name in MAPS:
        rows = rows.union(state(name, "user_map_value.bytes", "user_map_key.doc_id" if name == "labels" else "user_map_key.number"))

    def restore(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        maps = {x: {} for x in ("small", *MAPS)}
        for name, k, held in zip(rows["name"], rows["k"], rows["held"], strict=True):
            maps[name][k] = bytes(held)
        pf = restored_filter(maps["small"].get(0), maps, params, vocab_size)
        recorder, out = Recorder(pf, key[0], eval_every, models, labelled), []
        if finish:
            emitted = {d: pickle.loads(x)[2] for d, x in maps["labels"].items()}
            pf.finish()
            out += recorder.evaluate(recorder.before)
            label = recorder.settled | pf.labels.of(pf.best(), list(pf.labels.open))
            changed = {d: x for d, x in sorted(label.items()) if emitted.get(d) != x}
            if changed:
                out.append(frame("label", key[0], iter=pf.seen + 1, doc_id=list(changed), topic=list(changed.values())))
            pf.settle()
        out += [*recorder.told(), *recorder.dump()]
        return pd.concat(out or [frame("event", key[0], iter=[])])

    return by_group(rows, "run_id").groupBy("run_id").applyInPandas(restore, REPLAYED)


def latest_labels(updates: DataFrame) -> DataFrame:
    best = F.max(F.struct("version", "label")).alias("b")
    return updates.groupBy("run_id", "doc_id").agg(best).select("run_id", "doc_id", F.col("b.label").alias("label"))
