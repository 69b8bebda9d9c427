"""Table access and the DuckDB spelling of the shared hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rk(seed: int, salt: str, *ids: str) -> str:
    """``rank_key`` in DuckDB."""
    return f"md5(concat_ws('|', '{seed}', '{salt}', {', '.join(f'({i})::VARCHAR' for i in ids)}))"


def u(seed: int, salt: str, *ids: str) -> str:
    """``u01`` in DuckDB."""
    return f"(('0x' || substr({rk(seed, salt, *ids)}, 1, 13))::BIGINT / 4503599627370496.0)"


def shard(key: str, n: int) -> str:
    """``shard_of`` in DuckDB."""
    return f"((('0x' || substr(md5(({key})::VARCHAR), 1, 15))::BIGINT) % {n})::INT"
