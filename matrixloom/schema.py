"""Column checks and the fixed dimensions of the domain."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The nine curated programs in their reporting order.
PROGRAM_ORDER = (
    "Vascular/stromal/interstitial ECM",
    "Epithelial/mucosal basement membrane ECM",
    "CNS/neural ECM",
    "Retinal/sensory ECM",
    "Immune/lymphoid remodeling ECM",
    "Stromal remodeling ECM",
    "Renal/endothelial basement membrane ECM",
    "Hepatic/plasma-associated ECM",
    "Reproductive-specialized ECM",
)


def slug_text(name: str) -> str:
    """``CNS/neural ECM`` -> ``cns_neural_ecm``."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """Return ``df`` or raise ``ValueError`` naming what is missing and what there is."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
    return df


def program_dimension(spark: SparkSession) -> DataFrame:
    """(program, slug, ord) of the nine curated programs."""
    rows = [(p, slug_text(p), i) for i, p in enumerate(PROGRAM_ORDER)]
    return spark.createDataFrame(rows, "program STRING, slug STRING, ord INT")
