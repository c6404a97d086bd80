"""Writing results: separate zones, CSV exports, audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: output zones ----------------------------------------------
UPLOADABLE, LOCAL_ONLY, KEYS = "uploadable", "local_only", "keys"


def zoned(df: DataFrame, exempt: str = "exempt") -> DataFrame:
    """Which zone each document belongs to.  Public originals are not copied anywhere."""
    return df.withColumn(
        "zone", F.when(F.col(exempt) == "local", LOCAL_ONLY).when(F.col(exempt).isNull(), UPLOADABLE)
    ).where(F.col("zone").isNotNull())


def write_zones(copies: DataFrame, path: str, sealed: DataFrame | None = None, keys_path: str | None = None) -> None:
    """Copies partitioned by zone; the sealed mapping goes to a folder of its own."""
    copies.write.mode("overwrite").partitionBy("zone").parquet(path)
    if sealed is not None:
        if not keys_path or keys_path.startswith(path.rstrip("/") + "/"):
            raise ValueError("the mapping needs a folder outside the copies")
        sealed.write.mode("overwrite").parquet(keys_path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def merge_sections(frames: Sequence[DataFrame]) -> DataFrame:
    """Per-section rows as one set with one header, ordered by section and row on reading.

    The order travels as ``section_no, row_no``; a global sort is left to the
    reader who wants one file.
    """
    merged = frames[0]
    for other in frames[1:]:
        merged = merged.unionByName(other)
    return merged


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)
