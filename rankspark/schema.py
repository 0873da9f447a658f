"""Column contracts. Every operator speaks these neutral names."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

QUERY, ANCHOR, CANDIDATE, CONTEXT, CORE, LABEL = (
    "query_id", "anchor", "candidate", "context", "core", "label")

# Column names under which existing matrices carry the same columns.
INPUT_NAMES = {
    "old_fragment_smiles": ANCHOR,
    "candidate_smiles": CANDIDATE,
    "replacement_fragment_smiles": CANDIDATE,
    "attachment_signature": CONTEXT,
    "core_key": CORE,
    "morgan": "sim",
    "bit_corr": "phi",
    "dHeavy": "d1",
    "dRings": "d2",
    "dMW": "d3",
    "dLogP": "d4",
    "dTPSA": "d5",
}

FEATURES = ["sim", "phi", "d1", "d2", "d3", "d4", "d5"]


def normalise_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename known input columns to the neutral names."""
    names = INPUT_NAMES if names is None else names
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def flag(cond) -> "F.Column":
    """Boolean condition as a 0/1 integer."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
