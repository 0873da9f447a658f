"""Hash orders, folds and identifiers. md5 gives the same value in every engine."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def joined(*cols) -> Column:
    return F.concat_ws("|", *[_c(c).cast("string") for c in cols])


def stable_hash(n: int, *cols) -> Column:
    """First ``n`` hex digits of md5 over the columns joined by ``|``."""
    return F.substring(F.md5(joined(*cols)), 1, n)


def hash_order(seed, *cols) -> Column:
    """Full md5 of seed and key: a reproducible random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def tie_key(query="query_id", candidate="candidate") -> Column:
    """Tie-breaker of a candidate inside its query, independent of input order."""
    return F.md5(joined(query, candidate))


def hash_int(text: Column) -> Column:
    """First 8 hex digits of md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_fold(key, n: int) -> Column:
    return F.pmod(hash_int(_c(key).cast("string")), F.lit(n)).cast("int")


def hash_mask(key, fraction: float) -> Column:
    """True for about ``fraction`` of the keys (10000 buckets)."""
    return F.pmod(hash_int(_c(key).cast("string")), F.lit(10000)) < int(round(fraction * 10000))


def md5_mod10(key) -> Column:
    """Whole 128-bit md5 modulo 10. 16**i is 6 modulo 10 for every i >= 1, so only digit sums are needed."""
    hexa = F.md5(_c(key).cast("string"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(31)),
                         lambda i: F.conv(hexa.substr(i, F.lit(1)), 16, 10).cast("int"))
    lead = F.aggregate(digits, F.lit(0), lambda a, d: a + d)
    last = F.conv(F.substring(hexa, 32, 1), 16, 10).cast("int")
    return F.pmod(lead * 6 + last, F.lit(10))


# Share of ten md5 buckets per split.
SPLIT_BUCKETS = {"train": 6, "val": 8, "test": 10}


def template_split(key) -> Column:
    d = md5_mod10(key)
    return (F.when(d < SPLIT_BUCKETS["train"], "train")
            .when(d < SPLIT_BUCKETS["val"], "val").otherwise("test"))
