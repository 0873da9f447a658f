"""User callbacks: generators, scorers, per-query policies and key extractors."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankspark.operators.graph import component_split
from rankspark.operators.ranking import rank_candidates

_GENERATORS: dict[str, Callable[..., DataFrame]] = {}


def register_generator(name: str, fn: Callable[..., DataFrame]) -> None:
    """K1: a generator maps (queries, **tables) to query_id, candidate, rank, fallback, reason."""
    _GENERATORS[name] = fn


def propose_with(name: str, queries: DataFrame, **tables) -> DataFrame:
    out = _GENERATORS[name](queries, **tables)
    need = {"query_id", "candidate", "rank", "fallback", "reason"}
    if not need <= set(out.columns):
        raise ValueError(f"generator {name} must return {sorted(need)}")
    return out


def score_with(frame: DataFrame, scorer: Column | Callable, *inputs: str, out: str = "score") -> DataFrame:
    """K2: a column expression, or a pandas function of the input columns applied in Arrow batches."""
    if isinstance(scorer, Column):
        return frame.withColumn(out, scorer)

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return scorer(*cols).astype("float64")

    return frame.withColumn(out, run(*[F.col(c) for c in inputs]))


def rerank_with(frame: DataFrame, policy: Callable[[pd.DataFrame], pd.DataFrame], query: str = "query_id",
                candidate: str = "candidate", score: str = "score") -> DataFrame:
    """K3: a user policy that orders one query's rows. It sees the whole query in the order of ``score``; a query is as large
    as the candidate vocabulary."""
    ranked = rank_candidates(frame, score, "_base", query, candidate)
    types = dict(ranked.dtypes)
    cols = [c for c in ranked.columns if c != "_base"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", rank int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o = policy(pdf.sort_values("_base"))
        return o[cols].assign(rank=range(1, len(o) + 1))
    return ranked.groupBy(query).applyInPandas(run, schema)


def split_with(frame: DataFrame, item: str, keys: Column, seed, **kw) -> DataFrame:
    """K4: component split where ``keys`` is any array expression over the item's columns."""
    return component_split(frame.select(item, F.explode(keys).alias("_key")), item, "_key", seed, **kw)
