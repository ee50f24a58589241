"""Tables with one row per key that are written in batches: base files, deltas, compaction.

A batch is a delta, cut into buckets by a hash of the key. Reading merges base and deltas: of the rows
of a key the one of the latest batch counts, within a batch the greatest by ``order``. Compaction
rewrites the buckets that deltas have touched, and only these; the others keep their files. A manifest
per compaction names each bucket's base version and the last batch it holds; it is written last, so a
compaction that fails leaves the table as it was, and is simply run again. A batch that is run again
overwrites its delta. Batches have growing numbers, and one writer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.records import latest_per_key

BUCKETS = 64
_BATCH, _BUCKET = "batch_id", "bucket"
_MANIFEST = "bucket int, version int, upto bigint"


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, where = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _filesystem(spark, path)
    fs.delete(where, True)


@dataclass(frozen=True)
class KeyedTable:
    path: str
    key: str
    order: tuple[str, ...]
    schema: T.StructType
    buckets: int = BUCKETS

    def _stored(self) -> T.StructType:
        extra = [T.StructField(_BATCH, T.LongType()), T.StructField(_BUCKET, T.IntegerType())]
        return T.StructType([*self.schema.fields, *extra])

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch; the same number again replaces it.

        Rows of a key are reduced before the shuffle, and a bucket is one or more tasks by its size.
        """
        own = latest_per_key(rows.select(*self.schema.names), self.key, self.order)
        placed = own.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), self.buckets).cast("int"))
        placed.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/delta/{_BATCH}={batch_id}")

    def manifest(self, spark: SparkSession) -> tuple[int, dict[int, int], int]:
        """(number, version of each bucket, last batch in the base); (0, {}, -1) before the first compaction."""
        numbers = [int(n) for n in children(spark, f"{self.path}/manifest") if n.isdigit()]
        for number in sorted(numbers, reverse=True):
            if "_SUCCESS" in children(spark, f"{self.path}/manifest/{number}"):
                rows = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{number}").collect()
                return number, {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, max(r["upto"] for r in rows)
        return 0, {}, -1

    def _batches(self, spark: SparkSession, after: int) -> list[int]:
        found = [int(n.split("=")[1]) for n in children(spark, f"{self.path}/delta") if n.startswith(f"{_BATCH}=")]
        return sorted(b for b in found if b > after and "_SUCCESS" in children(spark, f"{self.path}/delta/{_BATCH}={b}"))

    def _read(self, spark: SparkSession, base: str, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self._stored())
        return spark.read.schema(self._stored()).option("basePath", base).parquet(*folders)

    def _base(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/base/{v}/{_BUCKET}={b}" for b, v in versions.items()]
        parts = {}
        for b, v in versions.items():
            parts.setdefault(v, []).append(f"{self.path}/base/{v}/{_BUCKET}={b}")
        out = self._read(spark, f"{self.path}/base", []) if not folders else None
        for v, own in parts.items():
            # Rows of the base are older than those of any delta.
            rows = spark.read.schema(self._stored()).option("basePath", f"{self.path}/base/{v}").parquet(*own)
            rows = rows.withColumn(_BATCH, F.lit(-1).cast("bigint"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _deltas(self, spark: SparkSession, batches: Sequence[int]) -> DataFrame:
        return self._read(spark, f"{self.path}/delta", [f"{self.path}/delta/{_BATCH}={b}" for b in batches])

    def _merged(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, self.key, [_BATCH, *self.order])

    def read(self, spark: SparkSession) -> DataFrame:
        """One row per key: base and deltas merged on read."""
        _, versions, upto = self.manifest(spark)
        rows = self._base(spark, versions).unionByName(self._deltas(spark, self._batches(spark, upto)))
        return self._merged(rows).select(*self.schema.names)

    def compact(self, spark: SparkSession) -> list[int]:
        """Fold the deltas into the base; the buckets that were rewritten."""
        number, versions, upto = self.manifest(spark)
        batches = self._batches(spark, upto)
        if not batches:
            return []
        deltas = self._deltas(spark, batches)
        touched = sorted(r[_BUCKET] for r in deltas.select(_BUCKET).distinct().collect())
        old = self._base(spark, {b: v for b, v in versions.items() if b in touched})
        merged = self._merged(old.unionByName(deltas))
        target = f"{self.path}/base/{number + 1}"
        merged.drop(_BATCH).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(target)
        rows = [(b, v, max(batches)) for b, v in (versions | dict.fromkeys(touched, number + 1)).items()]
        listed = spark.createDataFrame(rows or [(-1, 0, max(batches))], _MANIFEST).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.path}/manifest/{number + 1}")
        return touched

    def vacuum(self, spark: SparkSession) -> None:
        """Remove what the last manifest no longer needs; readers of older manifests have to be done."""
        number, versions, upto = self.manifest(spark)
        for name in children(spark, f"{self.path}/delta"):
            if name.startswith(f"{_BATCH}=") and int(name.split("=")[1]) <= upto:
                remove(spark, f"{self.path}/delta/{name}")
        for v in children(spark, f"{self.path}/base"):
            for name in children(spark, f"{self.path}/base/{v}"):
                if name.startswith(f"{_BUCKET}=") and versions.get(int(name.split("=")[1])) != int(v):
                    remove(spark, f"{self.path}/base/{v}/{name}")
        for n in children(spark, f"{self.path}/manifest"):
            if n.isdigit() and int(n) < number:
                remove(spark, f"{self.path}/manifest/{n}")
