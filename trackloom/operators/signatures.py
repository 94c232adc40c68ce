"""Fingerprints of the set of examples a rule fires on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _set_hash(when: Column | None, seed: int) -> Column:
    """Order-free fingerprint of a set: the XOR of 64-bit hashes of its members.

    It is folded on the map side and never collects the members, however many there are.
    """
    h = F.xxhash64(F.lit(seed), "example_id", "label")
    return F.bit_xor(h if when is None else F.when(when, h))


def firing_signatures(fired: DataFrame, rule: Sequence[str]) -> DataFrame:
    """Signature of all firings and of the positive ones; two hashes and the count make collisions negligible."""
    label = F.col("label")
    agg = fired.groupBy(*rule).agg(
        F.count("*").alias("firings"),
        F.count_if(label).alias("positives"),
        *[_set_hash(None, s).alias(f"all_{s}") for s in (17, 92821)],
        *[_set_hash(label, s).alias(f"positive_{s}") for s in (17, 92821)],
    )
    return agg.select(
        *rule,
        "firings",
        F.concat_ws(":", "firings", "all_17", "all_92821").alias("signature"),
        F.concat_ws(":", "positives", "positive_17", "positive_92821").alias("coverage"),
    )
