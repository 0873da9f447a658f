"""Fingerprint expressions: bit-id arrays for text, packed words for small bit spaces."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hash_bit(token: Column, n_bits: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(n_bits)).cast("int")


def words(text) -> Column:
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value, body) -> Column:
    """``body(value)`` with the value computed once per row, also when ``body`` uses it inside other lambdas."""
    return F.transform(F.array(_c(value)), body)[0]


def word_shingles(text, n: int = 3) -> Column:
    """Overlapping runs of ``n`` words; shorter texts give one shingle of all their words."""
    return let(words(text), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))),
        lambda i: F.array_join(F.slice(w, i, n), " ")))


def fingerprint(tokens, n_bits: int = 2048) -> Column:
    """Sorted distinct bit ids of hashed tokens."""
    return F.array_sort(F.array_distinct(F.transform(_c(tokens), lambda t: _hash_bit(t, n_bits))))


def char_shingles(text, n: int = 3) -> Column:
    t = _c(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))),
                       lambda i: t.substr(i, F.lit(n)))


def tanimoto_counts(shared, size_a, size_b) -> Column:
    s, a, b = _c(shared).cast("double"), _c(size_a), _c(size_b)
    return s / F.greatest(a + b - s, F.lit(0.001))


def phi_counts(shared, size_a, size_b, n_bits: int) -> Column:
    """Pearson correlation of two bit vectors from their counts; 0 when undefined."""
    s, a, b = (_c(x).cast("double") for x in (shared, size_a, size_b))
    n = F.lit(float(n_bits))
    var = a * b * (n - a) * (n - b)
    return F.when(var > 0, (n * s - a * b) / F.sqrt(var)).otherwise(F.lit(0.0))


def tanimoto(a, b) -> Column:
    """Similarity of two bit-id arrays standing in one row."""
    return tanimoto_counts(F.size(F.array_intersect(_c(a), _c(b))), F.size(_c(a)), F.size(_c(b)))


def packed_tanimoto(a, b) -> Column:
    a, b = _c(a), _c(b)
    return tanimoto_counts(F.bit_count(a.bitwiseAND(b)), F.bit_count(a), F.bit_count(b))


def packed_phi(a, b, n_bits: int) -> Column:
    a, b = _c(a), _c(b)
    return phi_counts(F.bit_count(a.bitwiseAND(b)), F.bit_count(a), F.bit_count(b), n_bits)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))
