"""Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _primes(most: int) -> np.ndarray:
    sieve = np.ones(most + 1, dtype=bool)
    sieve[:2] = False
    for k in range(2, int(most**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    return np.flatnonzero(sieve)


def _divisors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of divisors of each, all of them one after the other, each one's in order);
    numbers below 1 have none. Numbers are sorted; a prime meets its multiples alone
    where they lie close together, and else all numbers that it may divide."""
    x, back = np.unique(x, return_inverse=True)
    x = np.maximum(x, 0)
    rest, at, prime, power = x.copy(), [], [], []
    low, high = int(x[x > 0].min(initial=1)), int(x.max(initial=0))
    for p in _primes(int(high**0.5) + 1).tolist():
        first = max(low + -low % p, p * p)  # what is smaller has a smaller factor, or is told by what is left
        if (high - first) // p < len(x) // 8:
            there = np.arange(first, high + 1, p)
            place = np.searchsorted(x, there)
            hit = place[x[place] == there]
        else:
            begin = int(np.searchsorted(x, first))
            hit = begin + np.flatnonzero(x[begin:] % p == 0)
        if len(hit):
            times = np.zeros(len(hit), dtype=np.int64)
            more = np.ones(len(hit), dtype=bool)
            while more.any():
                rest[hit[more]] //= p
                times += more
                more &= rest[hit] % p == 0
            at.append(hit), prime.append(np.full(len(hit), p)), power.append(times)
    last = np.flatnonzero(rest > 1)
    at, prime, power = (np.concatenate(v) for v in ([*at, last], [*prime, rest[last]], [*power, np.ones(len(last), dtype=np.int64)]))
    order = np.argsort(at, kind="stable")
    at, prime, power = at[order], prime[order], power[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    owner = np.flatnonzero(x > 0)
    value = np.ones(len(owner), dtype=np.int64)
    for k in range(int(rank.max(initial=-1)) + 1):  # each number's k-th prime: what it has times all its powers
        p, e = np.ones(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        mine = rank == k
        p[at[mine]], e[at[mine]] = prime[mine], power[mine]
        copies = e[owner] + 1
        j = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
        owner, value = np.repeat(owner, copies), np.repeat(value, copies)
        value = value * p[owner] ** j
    value = value[np.lexsort((value, owner))]
    size = np.bincount(owner, minlength=len(x))
    ends, size = np.cumsum(size), size[back]
    begin = ends[back] - size
    return size, value[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def factors(x: Column) -> Column:
    """All divisors of a positive integer, in order; of others, none. A batch of
    numbers is divided by primes up to its largest one's root."""

    @F.arrow_udf("array<int>")
    def found(v: pa.Array) -> pa.Array:
        size, value = _divisors(v.cast(pa.int32()).fill_null(0).to_numpy().astype(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(value.astype(np.int32)))

    return found(x)


def path_part(path: Column, back: int) -> Column:
    """The back-th part of a path from its end (1: the file); null where it is shorter."""
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def file_number(path: Column) -> Column:
    """The last number in a file's name: what natural order goes by."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)\D*$", 1).try_cast("long")


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums; 0 where either side doesn't vary."""
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    flat = (vx <= 1e-12 * F.abs(sxx)) | (vy <= 1e-12 * F.abs(syy))
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))), F.lit(0.0)))


def correlation_of(a: Column, b: Column) -> Column:
    """Pearson's r of two arrays of equal length; 0 where either doesn't vary.

    Both are centred by their means first, so that little is lost to rounding."""
    plus = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = lambda x: plus(x) / F.size(x)
    return _centred(a, b, mean(a), mean(b), plus)


def _centred(a: Column, b: Column, ma: Column, mb: Column, plus) -> Column:
    return F.coalesce(
        F.try_divide(
            plus(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))),
            F.sqrt(plus(F.transform(a, lambda x: (x - ma) * (x - ma))) * plus(F.transform(b, lambda y: (y - mb) * (y - mb)))),
        ),
        F.lit(0.0),
    )
