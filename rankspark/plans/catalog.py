"""Imports every module that registers queries."""
from rankspark.plans import (  # noqa: F401
    benchmark_queries, fusion_queries, metric_queries, model_queries, pair_queries, prior_queries, scalar_queries,
    similarity_queries, split_queries)
from rankspark.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
