"""Quality rules: statistics of each whole text, base rules on them, and an
isolation forest whose threshold is calibrated on labelled documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm import common
from topicloom.llm.common import WHITE, Scratch, chunks, is_long, prefix_hash, range_hash, run_values, windows, word_windows, words

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: What the forest looks at: ratios, so that the length of a text matters little.
FEATURES = ["log_words", "mean_word", "symbol_rate", "symbol_share", "dup_line_rate", "repeat_rate"]
#: Feature sets that a fit chooses from. Rare but harmless values of one feature
#: hide the anomalies of another, so fewer can be better.
FEATURE_SETS = [[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 3], [2, 3], [4, 5], [0, 1]]


def _firsts(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (doc, value) pair occurs twice or more, and whether the row
    is a later occurrence."""
    n = len(doc)
    order = np.lexsort((value, doc))
    same = np.zeros(n, bool)
    if n > 1:
        same[1:] = (doc[order[1:]] == doc[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    many = same.copy()
    many[:-1] |= same[1:]
    later, twice = np.zeros(n, bool), np.zeros(n, bool)
    later[order], twice[order] = same, many
    return twice, later


def _long_stats(raw: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """text_stats of one long text, of which only a hash a line and a window of
    words is held."""
    white, symbol = (np.zeros(256, bool) for _ in range(2))
    white[list(WHITE)], symbol[list(SYMBOLS)] = True, True
    step = common.PIECE_BYTES
    n_words = word_chars = n_symbols = 0
    for k in range(0, len(raw), step):
        piece = raw[k : k + step]
        word_chars += int(np.count_nonzero(((piece & 0xC0) != 0x80) & ~white[piece]))
        n_symbols += int(np.count_nonzero(symbol[piece]))
    line = np.concatenate([value[held] for value, held in run_values(raw, b"\n")])
    n_dup_lines = len(line) - len(np.unique(line))
    del line
    parts = []
    for value, run in word_windows(raw, window):
        n_words += len(value)
        parts.append(run)
    runs = np.concatenate(parts)
    del parts
    value = np.sort(runs)
    same = value[1:] == value[:-1]
    same[1:] &= value[1:-1] != value[:-2]  # the first repeat of a value alone
    again = value[1:][same]
    del value, same
    inside = np.zeros(n_words, bool)
    for k in range(0, len(runs) if len(again) else 0, step):
        part = runs[k : k + step]
        hit = np.flatnonzero(again[np.minimum(np.searchsorted(again, part), len(again) - 1)] == part) + k
        for j in range(window):
            inside[hit + j] = True
    found = n_words, word_chars, n_symbols, n_dup_lines, int(np.count_nonzero(inside))
    return {k: np.array([x], np.int64) for k, x in zip(STATS, found, strict=True)}


def text_stats(raw: np.ndarray, at: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The statistics of each document in one block of bytes."""
    n_docs = len(at) - 1
    if not len(raw):
        return {k: np.zeros(n_docs, np.int64) for k in STATS}
    if is_long(raw, at):
        return _long_stats(raw, window)
    start, end, first = words(raw, at)
    n_words = np.diff(first)
    word_doc = np.repeat(np.arange(n_docs), n_words)
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    word_chars = np.bincount(word_doc, leads[end] - leads[start], n_docs)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    symbols = np.concatenate(([0], np.cumsum(symbol[raw])))
    sums = prefix_hash(raw)

    # lines: cut at \n and at documents' ends
    breaks = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate((at[:-1], breaks + 1)))
    line_start = line_start[line_start < len(raw)]
    line_end = np.concatenate((line_start[1:], [len(raw)]))
    line_end = line_end - ((raw[line_end - 1] == 10) & (line_end > line_start))
    held = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[held], line_end[held]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    _, later = _firsts(line_doc, range_hash(sums, line_start, line_end))
    n_dup_lines = np.bincount(line_doc[later], minlength=n_docs)

    # words in windows that occur twice or more
    covered = np.zeros(len(start) + 1, np.int64)
    runs = windows(range_hash(sums, start, end), window)
    if len(runs):
        whole = word_doc[: len(runs)] == word_doc[window - 1 :]
        place = np.flatnonzero(whole)
        # two windows alike share their sorted neighbours: a sort of hashes finds those that can repeat
        value = np.sort(runs[place])
        again = np.unique(value[1:][value[1:] == value[:-1]])
        if len(again):
            hit = again[np.minimum(np.searchsorted(again, runs[place]), len(again) - 1)] == runs[place]
            place = place[hit]
            twice, _ = _firsts(word_doc[place], runs[place])
            place = place[twice]
            np.add.at(covered, place, 1)
            np.add.at(covered, place + window, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return {
        "n_words": n_words,
        "word_chars": word_chars.astype(np.int64),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(word_doc[inside], minlength=n_docs),
    }


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, STATS) for each document, read whole; a null text counts as
    empty. No shuffle."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches, "_text"):
            stats = text_stats(raw, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[k], pa.int64()) for k in STATS)], names=[id_col, *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(kernel, f"`{id_col}` {kind}, " + ", ".join(f"{k} bigint" for k in STATS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _features() -> list[F.Column]:
    words_or_one = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
        (F.col("word_chars") / words_or_one).alias("mean_word"),
        (F.col("n_symbols") / words_or_one).alias("symbol_rate"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")).alias("symbol_share"),
        (F.col("n_dup_lines") / words_or_one).alias("dup_line_rate"),
        (F.col("n_repeat_words") / words_or_one).alias("repeat_rate"),
    ]


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list[list[float]]:
    """A random tree as rows [feature, split, left, right, path]; feature -1
    marks a leaf."""
    tree: list[list[float]] = []
    todo = [(rows, depth, -1, 0)]
    while todo:
        part, d, parent, side = todo.pop()
        if parent >= 0:
            tree[parent][2 + side] = len(tree)
        low, high = part.min(0), part.max(0)
        open_ = np.flatnonzero(high > low)
        if d >= limit or len(part) <= 1 or not len(open_):
            tree.append([-1, 0.0, 0, 0, d + _average_path(len(part))])
            continue
        f = int(rng.choice(open_))
        split = float(rng.uniform(low[f], high[f]))
        tree.append([f, split, 0, 0, 0.0])
        left = part[:, f] < split
        if not left.any():
            left = part[:, f] <= split
        me = len(tree) - 1
        todo += [(part[~left], d + 1, me, 1), (part[left], d + 1, me, 0)]
        tree[me][1] = split if (part[:, f] < split).any() else float(np.nextafter(split, np.inf))
    return tree


def path_lengths(forest: list[list[list[float]]], rows: np.ndarray) -> np.ndarray:
    """Mean path of each row over all trees."""
    total = np.zeros(len(rows))
    for tree in forest:
        t = np.asarray(tree)
        node = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            f = t[node[live], 0].astype(np.int64)
            live, f = live[f >= 0], f[f >= 0]
            left = rows[live, f] < t[node[live], 1]
            node[live] = np.where(left, t[node[live], 2], t[node[live], 3]).astype(np.int64)
        total += t[node, 4]
    return total / max(1, len(forest))


def anomaly_score(forest: list, rows: np.ndarray, size: int) -> np.ndarray:
    return 2.0 ** (-path_lengths(forest, rows) / max(_average_path(size), 1e-9))


def fit_forest(stats: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", trees: int = 64, tree_rows: int = 256, labelled_rows: int = 20000, false_reject: float = 0.001, seed: int = 11) -> dict:
    """A forest and its threshold, calibrated on labelled documents.

    Fitted on the labelled documents that pass the base rules, or, if there are
    more than ``labelled_rows`` of them, on about nine tenths of that number,
    picked by a threshold on their hashed ids; never more reach the driver, however
    many tasks there are. Each tree sees ``tree_rows``. The threshold lets the
    share ``false_reject`` of good documents go; of the feature sets, the one that
    then finds most bad documents is taken. Without labelled rows the forest
    rejects nothing.
    """
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("quality").alias("quality"))
    picked = scratch.keep(stats.where(~base_failed()).join(known, id_col).select(*_features(), "quality", F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")), "labelled")
    n = picked.count()
    if n > labelled_rows:
        picked = picked.where(F.pmod("h", F.lit(1 << 30)) < int(0.9 * labelled_rows / n * (1 << 30)))
    rows = sorted((tuple(r) for r in picked.limit(labelled_rows).collect()), key=lambda r: r[-1])
    sample = np.array([r[:-1] for r in rows], float).reshape(-1, len(FEATURES) + 1)
    good = sample[:, -1] == 1
    if good.sum() < 2:
        return {"forest": [], "size": 1, "threshold": 2.0, "features": FEATURE_SETS[0]}
    size = min(tree_rows, len(sample))
    limit = int(np.ceil(np.log2(max(size, 2))))
    best = None
    for chosen in FEATURE_SETS:
        rng = np.random.default_rng(seed)
        rows = sample[:, chosen]
        forest = [grow_tree(rows[rng.choice(len(rows), size, replace=False)], rng, 0, limit) for _ in range(trees)]
        scores = anomaly_score(forest, rows, size)
        threshold = float(np.quantile(scores[good], 1.0 - false_reject))
        found = int((scores[~good] > threshold).sum())
        if best is None or found > best[0]:
            best = found, {"forest": forest, "size": size, "threshold": threshold, "features": chosen}
    return best[1]


def judge(stats: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """Adds base_failed, score and kept to statistics. A document is kept when it
    passes the base rules and its anomaly score is at most the threshold."""
    wide = stats.select("*", base_failed().alias("base_failed"), *_features())
    sent = stats.sparkSession.sparkContext.broadcast(json.dumps(model))  # trees x 2 * tree_rows nodes at most
    names = [id_col, *STATS, "base_failed"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(sent.value)
        for batch in batches:
            rows = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in (FEATURES[i] for i in m["features"])], 1)
            score = anomaly_score(m["forest"], rows, m["size"]) if m["forest"] else np.zeros(len(rows))
            failed = batch.column(batch.schema.get_field_index("base_failed")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in names), pa.array(score), pa.array(~failed & (score <= m["threshold"]))], names=[*names, "score", "kept"])

    kind = stats.schema[id_col].dataType.simpleString()
    return wide.mapInArrow(kernel, f"`{id_col}` {kind}, " + ", ".join(f"{k} bigint" for k in STATS) + ", base_failed boolean, score double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, scratch: Scratch, **fit) -> DataFrame:
    """Judges every document by its whole text.

    Null and empty texts have no words and fail the base rules; repeated rows
    are judged alike; extra columns of ``docs`` are not read. An empty table
    gives an empty result. Statistics are computed once and written to the
    shared folder, as the fit and the judgement both read them.
    """
    stats = scratch.keep(rule_stats(docs), "stats")
    return judge(stats, fit_forest(stats, labels, scratch, **fit))
