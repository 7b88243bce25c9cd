"""Tables in hash buckets: a merge reads and writes the buckets of its rows only, and readers see whole versions.

``data/at=<version>/bucket=<n>`` holds the rows of a bucket as of a version; ``manifest/version=<v>`` is one small file that
names, for each bucket with rows, the version it was last written in. The manifest is written last and its file is moved
into place whole, so a reader finds the old version or the new one, never a part. Two writers of one version collide: the
second fails. The number of folders of a version depends on the buckets, not on the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 256
MANIFEST = "bucket INT, at BIGINT, buckets INT, version BIGINT"


class BucketTable:
    """A table at ``path`` with the columns of ``schema`` (DDL), in buckets by the columns ``by``, sorted by ``order``."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, by: Sequence[str], order: Sequence[str] = (), buckets: int = BUCKETS
    ) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.by, self.order, self.buckets = list(by), list(order), buckets

    def bucket(self, *values: Column) -> Column:
        """The bucket of a row, or of given values of the columns ``by``."""
        return F.pmod(F.xxhash64(*(values or self.by)), F.lit(self.buckets)).cast("int")

    def _latest(self) -> tuple[int, dict[int, int]]:
        """The newest version and where each bucket lies; -1 and nothing before the first one."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, {}
        newest = rows.agg(F.max("version")).first()[0]
        if newest is None:
            return -1, {}
        found = rows.where(F.col("version") == newest).collect()  # a row for each bucket
        if found[0]["buckets"] != self.buckets:
            raise ValueError(f"the table has {found[0]['buckets']} buckets, not {self.buckets}")
        return newest, {r["bucket"]: r["at"] for r in found if r["bucket"] is not None}

    def version(self) -> int:
        """The newest version, counted from 0; -1 for a table that nothing was written to."""
        return self._latest()[0]

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of the newest version, of all buckets or of the given ones; only their files are opened."""
        return self._rows(self._latest()[1], buckets)

    def _rows(self, places: dict[int, int], buckets: Iterable[int] | None) -> DataFrame:
        wanted = sorted(places if buckets is None else set(buckets) & set(places))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/at={places[b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read_key(self, **values) -> DataFrame:
        """The rows with the given values of the columns ``by``, from their bucket alone."""
        literals = [F.lit(values[c]) for c in self.by]
        bucket = self.spark.range(1).select(self.bucket(*literals)).first()[0]
        rows = self.read([bucket])
        for name in self.by:
            rows = rows.where(F.col(name).eqNullSafe(F.lit(values[name])))
        return rows

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into; as many as there are buckets at most."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def write(self, rows: DataFrame, placed: bool = False) -> int:
        """Replaces the whole table; gives the new version. ``placed`` rows lie by bucket already, few buckets to a task."""
        version, _ = self._latest()
        return self._commit(None if placed else rows, version + 1, {}, rows if placed else None)

    def merge(
        self,
        batch: DataFrame,
        combine: Callable[[DataFrame, DataFrame], DataFrame],
        stays: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    ) -> int:
        """Replaces the buckets that ``batch`` falls into by ``combine(their rows, batch)``; gives the new version.

        What ``combine`` returns must fall into the same buckets. All other buckets keep their files. ``stays`` gives rows
        of the same buckets that are added as they are: they are copied bucket by bucket, without a shuffle.
        """
        batch = cut_lineage(batch)
        version, places = self._latest()
        buckets = self.touched(batch)
        if not buckets:
            return version
        old = self._rows(places, buckets)
        kept = {b: at for b, at in places.items() if b not in set(buckets)}
        return self._commit(combine(old, batch), version + 1, kept, stays(old, batch) if stays else None)

    def _commit(self, rows: DataFrame | None, version: int, kept: dict[int, int], placed: DataFrame | None = None) -> int:
        """Rows are spread by bucket, large buckets over several tasks and files; ``placed`` ones are written where they lie."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]

        def bucketed(df: DataFrame) -> DataFrame:
            return df.select(*names).withColumn("bucket", self.bucket())

        parts = [bucketed(rows).hint("rebalance", "bucket")] if rows is not None else []
        parts += [bucketed(placed)] if placed is not None else []
        written = f"{self.path}/data/at={version}"
        reduce(DataFrame.unionAll, parts).sortWithinPartitions("bucket", *self.order).write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(written)
        stored = self.spark.read.schema(f"{self.schema}, bucket INT").parquet(written).select("bucket").distinct().collect()
        clash = {r[0] for r in stored} & set(kept)
        if clash:
            raise ValueError(f"rows of a merge fell into buckets that it did not read: {sorted(clash)[:5]}")
        places = [(b, at, self.buckets) for b, at in kept.items()] + [(r[0], version, self.buckets) for r in stored]
        manifest = self.spark.createDataFrame(places or [(None, None, self.buckets)], "bucket INT, at BIGINT, buckets INT")
        manifest.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/version={version}")
        return version
