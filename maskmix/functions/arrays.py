"""Column expressions over feature and mask arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the portable hash: two multipliers, an offset and the prime 2^31 - 1.
HASH_PRIME = 2147483647
HASH_ID = 48271
HASH_SEED = 69621
HASH_OFFSET = 11


def double(value: float) -> Column:
    return F.lit(float(value))


def double_array(values) -> Column:
    """A literal ARRAY<DOUBLE>; for vectors with one value per dimension."""
    return F.array(*[double(v) for v in values])


def binary_mask(weights: Column) -> Column:
    """1 where the soft mask is exactly one, else 0."""
    return F.transform(weights, lambda w: F.when(w == 1, 1).otherwise(0).cast("tinyint"))


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: m.cast("string")), "")


def unmasked_dims(mask: Column) -> Column:
    """Zero-based positions of the ones, ascending."""
    return F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.get(mask, i) == 1)


def effective_dims(weights: Column) -> Column:
    return F.aggregate(weights, double(0), lambda total, w: total + w)


def parameter_count(dims: Column) -> Column:
    """Free parameters of one Gaussian with ``dims`` effective dimensions."""
    return dims * (dims + 1) / 2 + dims + 1


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda n, v: n + v
    )


def drop_last(values: Column, n: int) -> Column:
    return F.slice(values, F.lit(1), F.size(values) - n)


def select_bits(values: Column, bits: str) -> Column:
    """Keep the positions whose character in ``bits`` is '1'; positions past its end are dropped."""
    kept = [i for i, bit in enumerate(bits) if bit == "1"]
    return F.filter(
        F.transform(F.array(*[F.lit(i) for i in kept]), lambda i: F.get(values, i)),
        lambda v: v.isNotNull(),
    )


def portable_hash(key: Column, seed: int) -> Column:
    """Seeded integer in [0, 2^31 - 1); plain arithmetic, so any SQL engine repeats it."""
    first = (F.pmod(key.cast("long"), F.lit(HASH_PRIME)) * HASH_ID + (seed * HASH_SEED + HASH_OFFSET)) % HASH_PRIME
    return (first * first + HASH_OFFSET) % HASH_PRIME


def portable_hash_sql(key: str, seed: int) -> str:
    first = f"((({key}) % {HASH_PRIME}) * {HASH_ID} + {seed * HASH_SEED + HASH_OFFSET}) % {HASH_PRIME}"
    return f"((({first}) * ({first}) + {HASH_OFFSET}) % {HASH_PRIME})"


def portable_uniform(key: Column, seed: int) -> Column:
    """Seeded value in the open interval (0, 1)."""
    return (portable_hash(key, seed) + double(0.5)) / double(HASH_PRIME)


def portable_uniform_sql(key: str, seed: int) -> str:
    return f"(({portable_hash_sql(key, seed)} + CAST(0.5 AS DOUBLE)) / CAST({HASH_PRIME} AS DOUBLE))"


def random_integer(key: Column, seed: int, low: int, high: int) -> Column:
    """Seeded integer between ``low`` and ``high``, both included."""
    return portable_hash(key, seed) % (high - low + 1) + low
