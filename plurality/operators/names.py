"""Closest known name of an unknown one (A3).

Similarity is that of matching blocks: twice the characters in common blocks
(longest block first, then left and right of it) over both lengths. Names are
indexed by their bigrams. A pair that reaches the cutoff c has at least
c T / 2 characters in blocks, T being both lengths together, and at most
(1 - c) T outside, so at most (1 - c) T + 1 blocks; it shares at least
c T / 2 - (1 - c) T - 1 bigrams. That bound and the lengths leave few candidates
per name, and only those are compared.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFF = 0.82


def _bigrams(df: DataFrame, name: str) -> DataFrame:
    """A row per bigram of ``name``, repeated ones numbered, with the name's length."""
    places = F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1)))
    grams = df.select(name, F.length(name).alias(f"{name}_n"), F.explode(F.transform(places, lambda i: F.substring(F.col(name), i, F.lit(2)))).alias("gram"))
    counted = grams.groupBy(name, f"{name}_n", "gram").agg(F.count("*").alias("k"))
    return counted.select(name, f"{name}_n", "gram", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("nth"))


def candidates(unknown: DataFrame, names: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(unknown, known) pairs that may reach the cutoff; every pair that does is among them."""
    if cutoff <= 0.8:  # short names may reach less without a common bigram
        raise ValueError("the bigram bound holds for cutoffs above 0.8")
    left, right = _bigrams(unknown, "unknown"), _bigrams(names, "known")
    both = left.join(right, ["gram", "nth"])
    total = F.col("unknown_n") + F.col("known_n")
    fits = 2 * F.least("unknown_n", "known_n") >= F.lit(cutoff) * total - F.lit(1e-9)
    shared = both.where(fits).groupBy("unknown", "known", "unknown_n", "known_n").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= (1.5 * cutoff - 1) * total - 1 - 1e-9).select("unknown", "known")


def closest(unknown: DataFrame, names: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``unknown, known, ratio``: the most similar name with a ratio of at least ``cutoff`` (ties: the last in byte order);
    unknown names without one have no row. ``unknown``: (unknown), ``names``: (known); nulls are passed over, repeated names count once.
    """
    pairs = candidates(unknown.where("unknown IS NOT NULL").distinct(), names.where("known IS NOT NULL").distinct(), cutoff)

    def run(batches: Iterator) -> Iterator:
        from difflib import SequenceMatcher

        import pyarrow as pa

        matcher = SequenceMatcher()
        for batch in batches:
            ratios = []
            for word, name in zip(batch.column("unknown").to_pylist(), batch.column("known").to_pylist(), strict=True):
                matcher.set_seqs(name, word)
                ratios.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratios, pa.float64())], ["unknown", "known", "ratio"])

    scored = pairs.mapInArrow(run, "unknown string, known string, ratio double").where(F.col("ratio") >= cutoff)
    best = scored.groupBy("unknown").agg(F.max(F.struct("ratio", "known")).alias("b"))
    return best.select("unknown", "b.known", "b.ratio")
