"""Operators for training data. Nothing outside this package imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from plumbline.llm import canonical_values, charforms, chatdefects, grouped_split, mixing, mojibake, overlap, tokenise, truncation

    functions = (
        charforms.p1_found, charforms.p1_names,
        truncation.p2_found, truncation.p2_rates,
        chatdefects.p3_found, chatdefects.p3_sources,
        overlap.p4_found, overlap.p4_counts,
        grouped_split.p5_found, grouped_split.p5_splits, grouped_split.p5_shares, grouped_split.p5_torn,
        canonical_values.p6_found, canonical_values.p6_unmatched,
        tokenise.p7_ids, tokenise.p7_round_trip,
        mixing.p8_mixture, mixing.p8_shares, mixing.p8_capped_shares,
        mojibake.p9_found, mojibake.p9_originals,
    )
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    from plumbline.llm import grouped_split

    return {"p5_found": grouped_split.P5_FOUND_SQL, "p5_splits": grouped_split.P5_SPLITS_SQL, "p5_shares": grouped_split.P5_SHARES_SQL, "p5_torn": grouped_split.P5_TORN_SQL}
