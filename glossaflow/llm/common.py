"""What the operators share: reading, shared storage, batch sizes, word bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import discard, fresh_path, shared_dir, ship, spread, stored  # noqa: F401

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows per Arrow batch for whole-text Python stages: long texts stay within memory.
ARROW_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Readies a session for Python stages over texts: workers get the package, and a batch few rows, as it holds whole texts."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
