"""Writers (S-16, S-17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from colloquy.operators import aggregates as ag
from colloquy.session import cut


def write_tables(tables: Mapping[str, DataFrame], root: str, partition_by: Sequence[str] = ("condition", "scenario", "timepoint"), fmt: str = "parquet") -> None:
    """S-16: each table under its name, partitioned by the keys it has.

    Rows are brought together by partition value, split further by file size, so a large
    partition is written by several tasks and a small one by one.
    """
    for name, df in tables.items():
        keys = [k for k in partition_by if k in df.columns]
        w = df.write.mode("overwrite")
        if keys and fmt == "parquet":
            w = w.partitionBy(*keys)
        w = w.option("header", True) if fmt == "csv" else w
        w.format(fmt).save(f"{root}/{name}")


def merged_bundle(df: DataFrame, block: Mapping[str, str], levels: Sequence[str], unit: str, sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """S-17: merged table, column inventory, block summary, unit counts, source summary."""
    inv = cut(ag.column_inventory(df, block))
    return {
        "merged": df, "columns": inv, "blocks": ag.block_summary(inv), "units": ag.unit_counts(df, levels, unit),
        "sources": ag.source_summary(sources, unit),
    }


def export_merged_bundle(bundle: Mapping[str, DataFrame], root: str) -> None:
    """S-17"""
    write_tables(bundle, root, ())
