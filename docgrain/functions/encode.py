"""Deterministic encoders as Column expressions: hash vectors, hash terms, normalisation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_word(hexed: Column) -> Column:
    """The first 32 bits of a hex digest, as an unsigned number."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def hash_components(text: Column, dim: int = 8) -> Column:
    """dim components in [-1, 1): 32 bits of SHA-256 of 'i:text'."""
    return F.array(*[first_word(F.sha2(F.concat(F.lit(f"{i}:"), text), 256)) / F.lit(4294967296.0) * 2.0 - 1.0 for i in range(dim)])


def l2_normalized(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0.0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def hash_dense(text: Column, dim: int = 8) -> Column:
    return l2_normalized(hash_components(text, dim))


def hash_term(token: Column, modulus: int = 10_000) -> Column:
    return first_word(F.sha2(token, 256)) % F.lit(modulus)


def term_slot(token: str, modulus: int = 10_000) -> int:
    """hash_term() of one token, for walks inside tasks."""
    return int.from_bytes(hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()[:4], "big") % modulus


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (size(a) * size(b))
