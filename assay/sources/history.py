"""A table of rows under keys that grows by commits: insert, replace, delete, point get, newest page, compaction.

A commit is one folder of operations, laid out by buckets of the key; a delete is an operation too, so nothing written is changed. A reader merges: of each
key the last operation counts. A commit holds once its line is in the table of commits, which is appended after its data, so a reader sees
all of it or nothing. Compaction writes what is left as one commit that stands for those before it. There is one writer at a time; folders of
commits that nobody counts any more may be deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
PUT, DELETE = "put", "delete"


class History:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", at: str = "created_at", buckets: int = BUCKETS):
        """``schema`` has the key and the column ``at`` by which rows are newest; both are never null."""
        self.spark, self.path, self.key, self.at, self.buckets = spark, path, key, at, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, op string, seq long, commit long, bucket int"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _commits(self) -> list[tuple[int, str]]:
        """Numbers and kinds of the commits that count: from the last compaction on."""
        import pyspark.errors

        try:
            lines = self.spark.read.schema("number long, kind string").parquet(f"{self.path}/commits")
            last = lines.filter("kind = 'all'").agg(F.max("number")).first()[0]
            rows = lines.filter(F.col("number") >= (0 if last is None else last)).collect()  # as many as there were commits since
        except pyspark.errors.AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = []
        return sorted((r["number"], r["kind"]) for r in rows)

    def _write(self, rows: DataFrame, kind: str) -> None:
        number = max((n for n, _ in self._commits()), default=0) + 1
        laid = rows.withColumn("bucket", self._bucket(F.col(self.key))).repartition("bucket")
        laid.drop("commit").write.partitionBy("bucket").parquet(f"{self.path}/data/commit={number}")
        self.spark.createDataFrame([(number, kind)], "number long, kind string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _operations(self) -> DataFrame:
        numbers = [n for n, _ in self._commits()]
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/commit={n}" for n in numbers])
        return found

    def _merged(self, operations: DataFrame) -> DataFrame:
        row = F.struct(*operations.columns)
        last = operations.groupBy("bucket", self.key).agg(F.max_by(row, F.struct("commit", "seq")).alias("r"))
        return last.select("r.*").filter(F.col("op") == PUT)

    def _checked(self, rows: DataFrame, order: str | None) -> DataFrame:
        seq = F.lit(0) if order is None else F.col(order)
        return rows.select(*self.columns, seq.cast("long").alias("seq"))

    def put(self, rows: DataFrame, order: str | None = None) -> None:
        """Insert rows or replace those of their keys; of rows of one key the one of the largest ``order`` stays."""
        self._write(self._checked(rows, order).withColumn("op", F.lit(PUT)), "some")

    def insert(self, rows: DataFrame) -> None:
        """Insert rows whose keys are new, else raise."""
        own = rows.groupBy(self.key).count().filter("count > 1").select(self.key)
        old = self._merged(self._operations()).select(self.key).join(rows.select(self.key).distinct(), self.key)
        doubled = own.unionByName(old).limit(1).collect()
        if doubled:
            raise ValueError(f"there is a row {doubled[0][0]!r} already")
        self.put(rows)

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of ``keys``; how many there were."""
        gone = self.state().join(keys.select(self.key).distinct(), self.key, "left_semi")
        n = gone.count()
        if n:
            self._write(self._checked(gone, None).withColumn("op", F.lit(DELETE)), "some")
        return n

    def apply(self, operations: DataFrame, order: str) -> None:
        """One commit of puts and deletes, told by a column ``op``, in their order."""
        self._write(operations.select(*self.columns, "op", F.col(order).cast("long").alias("seq")), "some")

    def state(self) -> DataFrame:
        return self._merged(self._operations()).select(*self.columns)

    def get(self, key) -> DataFrame:
        """The row of a key, if there is one; only its bucket is read."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(key))).first()[0]
        own = self._operations().filter((F.col("bucket") == bucket) & (F.col(self.key) == key))
        return self._merged(own).select(*self.columns)

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """The newest rows, the later operation first among those of one time, then the smaller key."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset are not negative")
        rows = self._merged(self._operations())
        return rows.orderBy(F.desc(self.at), F.desc("commit"), F.desc("seq"), self.key).select(*self.columns).offset(offset).limit(limit)

    def compact(self) -> None:
        """Write the rows that are left as one commit; reads begin there."""
        self._write(self._merged(self._operations()).select(*self.columns, "op", (F.shiftleft("commit", 40) + F.col("seq")).alias("seq")), "all")


def shortened(text: Column, most: int = 100) -> Column:
    """The text as a list of rows shows it."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
