"""Very long texts are read in pieces: the same results, in bounded memory."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

WORDS = ["a", "Ab", "zebra", "é", "日本語", "x#y", "$", "lorem", "\n", "\n\n", " \t", "Ω\n", "i" * 70]


def text(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    made = " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n))
    return np.frombuffer((made + "\n" + made[: rng.integers(0, len(made))]).encode(), np.uint8)


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_pieces_change_nothing(monkeypatch, piece):
    from topicloom.llm import common, lines, near, quality

    some = [text(k, 5 + 40 * k) for k in range(8)]
    some += [np.frombuffer(x, np.uint8) for x in (b"one", b" one two ", b"  \n \n", b"A b c D e", b"x" * 300, b"a\n" * 120, b"l one\nl one\nl one\n")]
    at = [np.array([0, len(x)]) for x in some]

    def all_of():
        for x, a in zip(some, at, strict=True):
            runs = lines.shortest_runs(x, a, 2, 80)
            hashes = [common.span_hash(x, runs[3], runs[4], lane) for lane in (0, 1)]
            stats = quality.text_stats(x, a)
            yield near.shingle_sets(x, a)[0], near._sequence_keys(x, a), *runs, *hashes, *(stats[k] for k in quality.STATS)

    want = list(all_of())
    monkeypatch.setattr(common, "PIECE_BYTES", piece)
    for x, y in zip(want, all_of(), strict=True):
        for one, two in zip(x, y, strict=True):
            np.testing.assert_array_equal(one, two)


def test_what_ranges_leave():
    from topicloom.llm.suffix import without

    rng = np.random.default_rng(3)
    for _ in range(200):
        own = rng.integers(0, 256, 60).astype(np.uint8)
        low = rng.integers(0, 55, rng.integers(0, 8))
        high = np.minimum(low + rng.integers(1, 12, len(low)), 60)
        gone = np.zeros(60, bool)
        for a, b in zip(low, high, strict=True):
            gone[a:b] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert without(own, pa.array(low), pa.array(high)) == (int(gone.sum()), spans, own[~gone].tobytes())
    assert without(own, None, None) == (0, 0, own.tobytes())


def test_lanes_without_repeats():
    from topicloom.llm.suffix import repeated_windows

    lane = np.array([1, 2]), np.array([0, 0]), [b"abcdefgh", b"hgfedcba"], False
    (doc, low, high), (_, _, windows) = repeated_windows([lane], 5)
    assert not len(doc) and not len(low) and not len(high) and windows == []


PEAK = """
import resource, sys
import numpy as np
rng = np.random.default_rng(1)
words = np.array([bytes(rng.integers(97, 123, rng.integers(2, 10)).astype(np.uint8)) for _ in range(5000)], dtype=object)
lines = [b" ".join(words[rng.integers(0, 5000, 12)]) for _ in range(20000)]
block = b"\\n".join(lines)
raw = np.frombuffer((block * (64 * 2**20 // len(block) + 1))[: 64 * 2**20], np.uint8)
at = np.array([0, len(raw)])
from topicloom.llm import common, lines, near, quality, suffix
kind = sys.argv[1]
if kind == "quality":
    quality.text_stats(raw, at)
elif kind == "near":
    near.minhash(near.shingle_sets(raw, at)[0]); near._sequence_keys(raw, at)
elif kind == "lines":
    runs = lines.shortest_runs(raw, at, 2, 80)
    for lane in (0, 1): common.span_hash(raw, runs[3], runs[4], lane)
else:
    doc, start, n, h, place = suffix.window_runs(raw, at, 100)
    common.span_hash(raw, start, start + n + 99)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("kind", ["quality", "near", "lines", "suffix"])
def test_peak_of_a_text_of_64_megabytes(kind):
    out = subprocess.run([sys.executable, "-c", PEAK, kind], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 600, out.stdout
