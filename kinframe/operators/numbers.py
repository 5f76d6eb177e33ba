"""Divisors of whole numbers: trial division by the primes up to the cube root, then a decision on what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinframe.session import ship_package

#: Bases that make the strong probable prime test exact for every 64-bit number.
BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def primes_to(limit: int) -> np.ndarray:
    """The primes up to ``limit`` (at most the cube root of a long: 2.1 million)."""
    sieve = np.ones(max(limit, 1) + 1, bool)
    sieve[:2] = False
    for p in range(2, int(limit ** 0.5) + 1):
        if sieve[p]:
            sieve[p * p::p] = False
    return np.flatnonzero(sieve)


def is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 and n != p for p in BASES):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in BASES:
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def count_divisors(values: np.ndarray) -> np.ndarray:
    """Number of divisors of every value; 0 below 1."""
    left, count = values.astype(np.int64).copy(), np.where(values > 0, 1, 0).astype(np.int64)
    left[values < 1] = 1
    active = np.arange(len(left))
    primes = primes_to(int(round(float(left.max(initial=1)) ** (1 / 3))) + 1)
    for at in range(0, len(primes), 64):
        active = active[left[active] > primes[at] ** 2]  # below the square of the next prime: 1 or a prime
        if not len(active):
            break
        for p in primes[at:at + 64]:
            hit, times = active[left[active] % p == 0], 1
            base = count[hit].copy()
            while len(hit):
                left[hit] //= p
                times += 1
                count[hit] = base * times
                more = left[hit] % p == 0
                hit, base = hit[more], base[more]
    # no factor up to the cube root is left: what remains is 1, a prime, a prime's square or two primes
    for i in np.flatnonzero(left > 1):
        m = int(left[i])
        root = int(m ** 0.5)
        root += (root + 1) ** 2 <= m
        root -= root * root > m
        count[i] *= 2 if is_prime(m) else 3 if root * root == m else 4
    return count


def with_divisors(values: DataFrame, col: str, out: str = "divisors") -> DataFrame:
    """``col, divisors``: the number of divisors of every (long) value, 0 below 1, null for null. Memory holds one batch
    and the primes up to the cube root of its greatest value."""
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            numbers = column.fill_null(0).to_numpy(zero_copy_only=False)
            found = pa.array(count_divisors(numbers), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([column, found], [col, out])

    ship_package(values.sparkSession)
    return values.select(values[col].cast("long").alias(col)).mapInArrow(run, f"`{col}` long, `{out}` long")
