"""Deterministic per-row numbers for folds, splits and samples; never `rand()`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Lehmer generator with prime modulus 2^31 - 1.
MODULUS = 2_147_483_647
MULTIPLIER = 48_271


def row_hash(key: str, seed: int = 0, method: str = "xxhash") -> Column:
    """A non-negative long below 2^52 (`xxhash`, any type) or below 2^31 - 1 (`linear`, integer keys).

    The linear form is plain integer arithmetic that any SQL engine repeats.
    """
    if method == "xxhash":
        return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**52))
    if method == "linear":
        return F.pmod(F.pmod(F.col(key).cast("long"), F.lit(MODULUS)) * MULTIPLIER + seed * 69_621 + 12_345, F.lit(MODULUS))
    raise ValueError(f"unknown hash method {method}")


def fold_of(key: str, folds: int, seed: int = 0, method: str = "xxhash") -> Column:
    return F.pmod(row_hash(key, seed, method), F.lit(folds)).cast("int")
