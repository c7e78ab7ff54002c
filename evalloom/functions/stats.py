"""Intervals, exact tests and quantiles as Column expressions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the normal quantile.
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771201e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def wilson(k: Column, n: Column, z: float = 1.96) -> dict[str, Column]:
    """p, lo and hi of a share k of n; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return {"p": p, "lo": F.when(centre - half < 0, 0.0).otherwise(centre - half), "hi": F.when(centre + half > 1, 1.0).otherwise(centre + half)}


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Of p kept within 0.005 and 0.995; null for null."""
    p = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.005)), F.lit(0.995)))
    tail = lambda t: _poly(ACKLAM_C, F.sqrt(-2 * F.log(t))) / _poly([*ACKLAM_D, 1.0], F.sqrt(-2 * F.log(t)))
    q = p - 0.5
    return F.when(p.isNull(), None).when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(_poly(ACKLAM_A, q * q) * q / _poly([*ACKLAM_B, 1.0], q * q))


def log_factorial(n: Column) -> Column:
    """By Stirling's series, eight places further on."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0)))
    product = n.cast("double") + 1
    for k in range(2, 9):
        product = product * (n.cast("double") + k)
    return series - F.log(product)


def fisher_exact(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-sided p of two shares; null if either sample is empty."""
    total, hits = n1 + n2, k1 + k2
    low, high = F.greatest(F.lit(0), hits - n2), F.least(hits, n1)
    fixed = log_factorial(n1) + log_factorial(n2) + log_factorial(hits) + log_factorial(total - hits) - log_factorial(total)
    lp = lambda x: fixed - log_factorial(x) - log_factorial(n1 - x) - log_factorial(hits - x) - log_factorial(n2 - hits + x)
    seen = lp(k1)
    summed = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda a, x: a + F.when(lp(x) <= seen + 1e-9, F.exp(lp(x))).otherwise(0.0))
    return F.when((n1 > 0) & (n2 > 0), F.least(F.lit(1.0), summed))


def mcnemar_exact(a_only: Column, b_only: Column) -> Column:
    """Two-sided exact binomial p at one half."""
    n, least = a_only + b_only, F.least(a_only, b_only)
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), least.cast("bigint")), F.lit(0.0), lambda s, i: s + F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * math.log(2)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def keyed_draw(*keys) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the keys only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(str(k)) for k in keys])), 1, 8), 16, 10).cast("bigint")


def keyed_uniform(*keys) -> Column:
    return keyed_draw(*keys) / 4294967296.0


def keyed_draws(*keys) -> Column:
    """Four numbers from 0 to 2**32 - 1 that depend on the keys only."""
    digest = F.md5(F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(str(k)) for k in keys]))
    return F.transform(F.array(*[F.lit(1 + 8 * j) for j in range(4)]), lambda at: F.conv(F.substr(digest, at, F.lit(8)), 16, 10).cast("bigint"))


#: Rounds of permuted_place, of which each takes one key.
ROUNDS = 12
#: Odd multipliers, below 2**32.
MULTIPLIERS = (2654435761, 2246822519)


def permuted_place(place: Column, n: Column, keys: Column) -> Column:
    """`place`, from 0 to n - 1, moved by a permutation that the array of ROUNDS keys (0 to 2**32 - 1) draws.

    Each round offers a place its mirror image about the round's key, and one bit that depends on the pair says for both
    whether they swap. So any row knows its new place by itself: nothing is sorted or shuffled.
    """

    def moved(at, key):
        mirror = F.pmod(key - at, n)
        mixed = F.greatest(at, mirror).bitwiseXOR(key).bitwiseAND(F.lit(0x7FFFFFFF)) * MULTIPLIERS[0]
        mixed = F.shiftright(mixed, 16).bitwiseAND(F.lit(0x7FFFFFFF)) * MULTIPLIERS[1]
        return F.when(F.shiftright(mixed, 29).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(at)

    return F.aggregate(keys, place, moved)


def permutation_keys(perms: int, seed: int = 0) -> np.ndarray:
    """The keys of permutations 1 to perms, ROUNDS each: what keyed_draws of the seed, the permutation's number and 0, 1, ... gives."""
    digests = [[hashlib.md5(f"{seed}|{p}|{four}".encode()).hexdigest() for four in range(ROUNDS // 4)] for p in range(1, perms + 1)]
    return np.array([[int(d[at : at + 8], 16) for d in row for at in range(0, 32, 8)] for row in digests], np.int64).reshape(perms, ROUNDS)


def permuted_places(place: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """permuted_place of many places for many permutations at once: a row for each row of keys."""
    at = np.broadcast_to(place.astype(np.int64), (len(keys), len(place)))
    for key in keys.T[:, :, None]:
        mirror = (key - at) % n
        mixed = ((np.maximum(at, mirror) ^ key) & 0x7FFFFFFF) * MULTIPLIERS[0]
        mixed = ((mixed >> 16) & 0x7FFFFFFF) * MULTIPLIERS[1]
        at = np.where(mixed >> 29 & 1, mirror, at)
    return at
