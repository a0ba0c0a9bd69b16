"""A keyed table in hash buckets, of which a change rewrites only those it touches.

``data/version=N/bucket=B`` holds what version N wrote of bucket B as Parquet, and
``manifest/version=N`` one row per filled bucket: the version that has its rows. A version
counts once its manifest, a single file, is there; so readers see all of a change or
nothing, and a change that failed half way is written over by the next one. Files of
earlier versions are left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, at int, batch long, version int"


class BucketStore:
    """One row per key. ``create`` makes an empty store with a fixed number of buckets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = spark.read.json(f"{self.path}/about", schema="keys array<string>, buckets int, schema string").first()
        self.keys, self.buckets = head["keys"], head["buckets"]
        self.schema = T.StructType.fromDDL(head["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = ("case_id", "model"), buckets: int = 64) -> BucketStore:
        path = path.rstrip("/")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        about = spark.createDataFrame([(list(keys), buckets, ddl)], "keys array<string>, buckets int, schema string")
        cls._commit(spark, path, 0, [], -1)
        about.coalesce(1).write.mode("overwrite").json(f"{path}/about")
        return cls(spark, path)

    @staticmethod
    def _commit(spark: SparkSession, path: str, version: int, held: list[tuple[int, int]], batch: int) -> None:
        rows = [(b, at, batch) for b, at in held] or [(None, None, batch)]
        table = spark.createDataFrame(rows, "bucket int, at int, batch long")
        table.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={version}")

    def manifest(self) -> tuple[int, int, dict[int, int]]:
        """Newest version, last batch taken in, and for each filled bucket the version that holds it."""
        every = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        newest = every.agg(F.max("version")).first()[0]
        rows = every.filter(F.col("version") == newest).collect()  # a row per bucket
        return newest, rows[0]["batch"], {r["bucket"]: r["at"] for r in rows if r["bucket"] is not None}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/version={at}/bucket={b}" for b, at in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        return self._rows(self.manifest()[2])

    def upsert(self, patch: DataFrame, value: str = "raw", order: Sequence[str] = (), batch: int | None = None) -> int:
        """Put new rows in; returns the version.

        Of the rows of a key that of the highest ``order`` wins, then the new one, but a null
        ``value`` never hides another. Only buckets with a key of the patch are read and
        written. A numbered ``batch`` is taken in once: the same or an earlier one again changes
        nothing.
        """
        version, done, held = self.manifest()
        if batch is not None and batch <= done:
            return version
        names = self.schema.fieldNames()
        new = patch.select(*[F.col(f"`{n}`") for n in names]).withColumn("_new", F.lit(1))
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most all buckets
        if not touched:
            if batch is not None:
                self._commit(self.spark, self.path, version + 1, list(held.items()), batch)
            return version + (batch is not None)
        old = self._rows({b: held[b] for b in touched if b in held}).withColumn("_new", F.lit(0))
        rank = F.struct(F.col(value).isNotNull(), *[F.col(c) for c in order], "_new", value)
        rest = F.struct(*[F.col(f"`{n}`") for n in names if n not in self.keys])
        # Combined on the map side, so that no key's rows are gathered.
        best = old.unionByName(new).groupBy(*self.keys).agg(F.max_by(rest, rank).alias("_row")).select(*self.keys, "_row.*")
        rows = best.select(*[F.col(f"`{n}`") for n in names], self._bucket().alias("bucket"))
        rows.repartition(min(len(touched), 2000), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version + 1}")
        now = held | {b: version + 1 for b in touched}
        self._commit(self.spark, self.path, version + 1, sorted(now.items()), done if batch is None else batch)
        return version + 1
