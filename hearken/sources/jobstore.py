"""Stored jobs for lookups by id: bucketed, sorted tables with Bloom filters.

A lookup reads the one bucket its id falls into, and of that the row groups whose bounds and Bloom filter let the id be there.
Two tables in the same buckets join without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, unless a caller knows better: some hundred megabytes each is a good size.
BUCKETS = 64


def write_jobs(jobs: DataFrame, name: str, key: str = "job_id", buckets: int = BUCKETS, path: str | None = None, distinct: int | None = None) -> DataFrame:
    """Write a table bucketed and sorted by ``key``, one file a bucket, and return it.

    ``distinct`` is how many keys a bucket may hold, for the size of the filters; if it is not given it is counted from the rows,
    roughly.  With ``path`` the files lie there, else in the warehouse.
    """
    if buckets < 1:
        raise ValueError("a table needs a bucket at least")
    if distinct is None:
        found = jobs.agg(F.approx_count_distinct(key, 0.05)).first()[0]
        distinct = max(1000, int(1.5 * found / buckets))
    # Rows are dealt out as the buckets are, so that each bucket is one task's and one file.
    rows = jobs.repartition(buckets, F.col(key))
    writer = rows.write.format("parquet").mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
    (writer.option("path", path) if path else writer).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return jobs.sparkSession.table(name)


def lookup(spark: SparkSession, name: str, ids: Iterable[str], key: str = "job_id") -> DataFrame:
    """The rows of some ids; of a null id none."""
    wanted = sorted({x for x in ids if x is not None})
    return spark.table(name).where(F.col(key).isin(wanted) if wanted else F.lit(False))


def lookup_all(requests: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Every request with its job's columns, null for unknown jobs; no shuffle where both are in the same buckets.

    Which side is hashed is left to Spark, but no side is broadcast: both may be of any size.
    """
    return requests.join(jobs.hint("merge"), key, "left")
