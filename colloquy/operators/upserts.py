"""Write semantics: what replaces what."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Incoming rows replace those of the same key, all others stay. Rows without a key are never replaced."""
    return existing.join(incoming.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Only rows of new keys are added."""
    return existing.unionByName(incoming.join(existing.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti"), allowMissingColumns=True)


def upsert_meeting(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A meeting's records replace all of that meeting, whatever their number: an id's last part is its position."""
    part = F.regexp_replace("id", "_[^_]*$", "")
    mine = incoming.select(part.alias("__slug")).distinct()
    kept = existing.withColumn("__slug", part).join(mine, "__slug", "left_anti").drop("__slug")
    return upsert(kept, incoming)


def foreign_sources(existing: DataFrame, produced: list[str]) -> list[str]:
    """Sources in a corpus that a writer could not make again; it must not overwrite these."""
    return sorted(r[0] for r in existing.where(~F.coalesce("source", F.lit("")).isin(produced)).select(F.coalesce("source", F.lit(""))).distinct().collect())


class Deltas:
    """A table of batches, merged when it is read: of the rows of a key the last batch's stands, and in it the latest by ``order``.

    Rows without a key all stay. compact() puts the merged rows in place of the batches, which keeps reading cheap.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", order: list[str] | None = None):
        self.spark, self.path, self.key, self.order = spark, path, key, order or []

    def write(self, batch: DataFrame, number: int) -> None:
        self._last(batch, self.order).write.mode("overwrite").parquet(f"{self.path}/__batch={number}")

    def _last(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row of each key, whole."""
        whole = F.struct(*rows.columns)
        by = F.struct(*order, F.xxhash64(*rows.columns)) if order else F.xxhash64(*rows.columns)
        known = rows.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("__key")).agg(F.max_by(whole, by).alias("__row")).select("__row.*")
        return known.unionByName(rows.where(F.col(self.key).isNull()))

    def read(self) -> DataFrame | None:
        try:
            rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return self._last(rows, ["__batch", *self.order]).drop("__batch")

    def compact(self, to: str) -> Deltas:
        """The merged rows as the first batch of a store beside this one."""
        fresh = Deltas(self.spark, to, self.key, self.order)
        if (rows := self.read()) is not None:
            rows.write.parquet(f"{to}/__batch=-1")
        return fresh


class Versions:
    """A table of whole versions: a new one is written beside the others, then named as the current one.

    A version is named by a pointer, a small file whose name is its number and which is put only if none of that number is
    there. So of two writers that start from one version, the second finds the number taken, reads what the first has
    made and tries again: neither is lost. Readers of the last version are never disturbed; a write that fails, or a
    pointer that was torn, leaves the last good one current.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._at) if f.getPath().getName().isdigit())

    def _named(self, n: int) -> str | None:
        """What a pointer names; None if it is torn."""
        stream = self._fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"{n:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") and len(text) > 1 else None

    def current(self) -> tuple[int, str | None]:
        """The greatest number that is taken, and the newest version whose pointer is whole."""
        found = self._pointers()
        for n in reversed(found):
            if name := self._named(n):
                return found[-1], name
        return (found[-1] if found else 0), None

    def read(self) -> DataFrame | None:
        _, name = self.current()
        return self.spark.read.parquet(f"{self.path}/{name}") if name else None

    def _put(self, n: int, name: str, end: str = "\n") -> bool:
        """Point number n at a version, if nothing has that number."""
        self._fs.mkdirs(self._at)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"{n:012d}")
        try:
            if self._fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then, which is not one step
                with open(self._fs.makeQualified(place).toUri().getPath(), "x") as f:
                    f.write(name + end)
            else:
                stream = self._fs.create(place, False)
                stream.write(bytearray((name + end).encode()))
                stream.close()
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass()) or self._fs.exists(place):
                return False
            raise
        return True

    def write(self, df: DataFrame) -> str:
        """These rows as the newest version, whatever others have written meanwhile."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        while not self._put(self.current()[0] + 1, name):
            pass
        return name

    def torn(self, df: DataFrame) -> None:
        """What a writer leaves that is lost while it writes its pointer: for tests of those who read."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self._put(self.current()[0] + 1, name, end="")

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> str:
        """change(current rows, None at first) as the next version; made again from what another writer has put first."""
        for _ in range(tries):
            n, was = self.current()
            name = f"v-{uuid.uuid4().hex}"
            change(self.spark.read.parquet(f"{self.path}/{was}") if was else None).write.parquet(f"{self.path}/{name}")
            if self._put(n + 1, name):
                return name
        raise RuntimeError(f"others have written {tries} versions first")
