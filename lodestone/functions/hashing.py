"""Deterministic hashes of keys, equal to big-integer arithmetic on hex digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_mod(digest: Column, chunks: int, modulus: int) -> Column:
    """The digest, as one big number, modulo ``modulus`` (below 2**31), by Horner's rule over 32-bit chunks."""
    out = F.lit(0).cast("long")
    for i in range(chunks):  # unrolled, so that it stays in generated code
        out = (out * F.lit(4294967296) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % F.lit(modulus)
    return out


def sha256_mod(key: Column, modulus: int) -> Column:
    return _hex_mod(F.sha2(key.cast("string"), 256), 8, modulus)


def md5_mod(key: Column, modulus: int) -> Column:
    return _hex_mod(F.md5(key.cast("string")), 4, modulus)


def stable_fraction(key: Column, seed: Column | str | int) -> Column:
    """First 8 bytes of SHA-256 of ``seed:key``, as a fraction of 2**64."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    head = F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)
