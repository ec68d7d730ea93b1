"""Independent documents side by side: a step of numpy takes the tokens at one place of many."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def dealt(sizes: Sequence[int], cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents in groups of like length, longest first: their places, and how many of
    the group are longer than 0, 1, ... A group times its longest has ``cells`` at most,
    or is one document."""
    sizes = np.asarray(sizes, np.int64)
    order, at = np.argsort(-sizes, kind="stable"), 0
    while at < len(order):
        longest = int(sizes[order[at]])
        group = order[at : at + max(1, cells // max(1, longest))]
        at += len(group)
        yield group, np.searchsorted(-sizes[group], -np.arange(longest), "left")


#: Topics below which a step takes one topic after another, each an array over documents:
#: numpy adds up so few numbers of a row one by one, so results are the same.
FEW_TOPICS = 8


def columns(docs: Sequence[np.ndarray], group: np.ndarray, longest: int) -> np.ndarray:
    """The documents of a group as columns, filled up with zeros."""
    out = np.zeros((longest, len(group)), docs[group[0]].dtype)
    for c, d in enumerate(group.tolist()):
        out[: len(docs[d]), c] = docs[d]
    return out
