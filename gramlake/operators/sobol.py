"""Sobol points with hashed Owen scrambling, as integer column expressions on the rows of
a table: row i has point i, on any partitioning.

Direction numbers follow from primitive polynomials over GF(2), found by rule, and from
first odd numbers fixed by a hash; a coordinate is the exclusive or of those at the set
bits of i. Scrambling flips each bit by a hash of the bits above it (on reversed bits:
x ^= x * even number, so that a bit depends on lower ones only), which keeps the net. All
numbers have BITS bits, so that products stay within 64.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order
from .sampling import scattered

BITS = 30
MASK = (1 << BITS) - 1
#: Even multipliers of the scrambling steps, below 2^BITS.
STEPS = tuple(2 * int(scattered(k, 7, 1) * (MASK >> 1)) for k in range(1, 5))


def _times(a: int, b: int, p: int, degree: int) -> int:
    """Product of two polynomials over GF(2) modulo p."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
        if a >> degree & 1:
            a ^= p
    return out


def _primitive(p: int, degree: int) -> bool:
    """Whether x has order 2^degree - 1 modulo p."""
    n = (1 << degree) - 1
    power = lambda e: reduce(lambda acc, bit: _times(_times(acc, acc, p, degree), 2 if bit == "1" else 1, p, degree), bin(e)[2:], 1)
    primes = [q for q in range(2, n + 1) if n % q == 0 and all(q % r for r in range(2, int(q**0.5) + 1))]
    return power(n) == 1 and all(power(n // q) != 1 for q in primes)


@cache
def polynomials(n: int) -> tuple[tuple[int, int], ...]:
    """The first n primitive polynomials (bits, degree), by degree."""
    out, degree = [(3, 1)], 2
    while len(out) < n:
        out += [(p, degree) for p in range((1 << degree) + 1, 2 << degree, 2) if _primitive(p, degree)]
        degree += 1
    return tuple(out[:n])


@cache
def directions(j: int) -> tuple[int, ...]:
    """Direction numbers of coordinate j, the first for the lowest bit of the index."""
    if j == 0:
        return tuple(1 << (BITS - 1 - k) for k in range(BITS))
    p, degree = polynomials(j)[-1]
    m = [2 * int(scattered(j, k, 3) * (1 << k)) + 1 for k in range(degree)]  # odd, below 2^(k+1)
    for k in range(degree, BITS):
        v = m[k - degree] ^ m[k - degree] << degree
        for q in range(1, degree):
            if p >> (degree - q) & 1:
                v ^= m[k - q] << q
        m.append(v)
    return tuple(m[k] << (BITS - 1 - k) for k in range(BITS))


def _reversed(x: Column) -> Column:
    return reduce(lambda a, k: a.bitwiseOR(F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), BITS - 1 - k)), range(1, BITS), F.shiftleft(x.bitwiseAND(F.lit(1)), BITS - 1))


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def coordinate(index: Column, j: int, seed: int | None = 42) -> Column:
    """Coordinate j of the Sobol point of an index from 0, in [0, 1); scrambled by seed."""
    i = index.cast("long")
    raw = reduce(lambda a, b: a.bitwiseXOR(b), (F.when(F.shiftright(i, k).bitwiseAND(F.lit(1)) == 1, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")) for k, v in enumerate(directions(j))))
    if seed is None:
        return raw / float(1 << BITS)
    start = int(scattered(j, 11, seed) * MASK)
    x = _let(raw, lambda v: (_reversed(v) + start).bitwiseAND(F.lit(MASK)))
    mixed = lambda x, step: _let(x, lambda v: v.bitwiseXOR((v * step).bitwiseAND(F.lit(MASK))))
    return (_let(reduce(mixed, STEPS, x), _reversed) + 0.5) / float(1 << BITS)


def coordinate_sql(index: str, j: int, seed: int = 42) -> str:
    """coordinate() in SQL."""
    flip = lambda v: f"list_reduce(list_transform(range({BITS}), lambda k: (({v}) >> k & 1) << ({BITS - 1} - k)), lambda a, b: a | b)"
    raw = f"list_reduce(list_transform({list(directions(j))}, lambda v, k: CASE WHEN ({index}) >> (k - 1) & 1 = 1 THEN v ELSE 0 END), lambda a, b: xor(a, b))"
    x = f"(({flip(raw)}) + {int(scattered(j, 11, seed) * MASK)}) & {MASK}"
    for step in STEPS:
        x = f"list_transform([{x}], lambda t: xor(t, (t * {step}) & {MASK}))[1]"
    return f"(({flip(x)}) + 0.5) / {float(1 << BITS)}"


def attached(df: DataFrame, key: str, d: int, seed: int = 42, out: str = "u") -> DataFrame:
    """df with an array of d coordinates: the row of rank k by key (from 0, keys distinct)
    has the point of index k."""
    ranked = order.global_rank(df, [key], "__rank")
    return ranked.withColumn(out, F.array(*(coordinate(F.col("__rank") - 1, j, seed) for j in range(d)))).drop("__rank")
