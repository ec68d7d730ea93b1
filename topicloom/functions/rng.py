"""Random numbers that do not depend on partitioning.

``token_hash`` is integer arithmetic that any SQL engine computes alike;
kernels take numpy generators keyed by (seed, purpose, unit of work).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def token_hash(doc: Column, pos: Column, sweep: int, seed: int) -> Column:
    """An integer in [0, MODULUS), from two squarings of a linear form."""
    m = F.lit(MODULUS).cast("long")
    h = F.pmod(F.pmod(doc.cast("long"), m) * F.lit(1103515245) + pos.cast("long") * F.lit(12345) + F.lit(sweep * 40503 + seed), m)
    for _ in range(2):
        h = F.pmod(h * h + F.lit(48271), m)
    return h


def uniform(doc: Column, pos: Column, sweep: int, seed: int) -> Column:
    return token_hash(doc, pos, sweep, seed) / F.lit(float(MODULUS))


def hash_array(doc: np.ndarray, pos: np.ndarray, sweep: int, seed: int) -> np.ndarray:
    """``token_hash`` of arrays."""
    h = (doc.astype(np.int64) % MODULUS * 1103515245 + pos.astype(np.int64) * 12345 + (sweep * 40503 + seed)) % MODULUS
    for _ in range(2):
        h = (h * h + 48271) % MODULUS
    return h


def uniform_array(doc: np.ndarray, pos: np.ndarray, sweep: int, seed: int) -> np.ndarray:
    return hash_array(doc, pos, sweep, seed) / float(MODULUS)


def token_hash_sql(doc: str, pos: str, sweep: int, seed: int) -> str:
    h = f"((({doc}) % {MODULUS}) * 1103515245 + ({pos}) * 12345 + {sweep * 40503 + seed}) % {MODULUS}"
    for _ in range(2):
        h = f"(({h}) * ({h}) + 48271) % {MODULUS}"
    return f"({h})"


def generator(seed: int, purpose: str, unit: int | str = 0) -> np.random.Generator:
    """An own stream for each purpose and unit, so that evaluating never shifts
    what learning draws."""
    words = np.array([seed & 0xFFFFFFFF, *purpose.encode(), *str(unit).encode()], np.uint32)  # of a list, numpy would make an array of each
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(words)))
