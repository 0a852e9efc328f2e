"""Deletion over several tables with a journal: a run that is killed between two steps is finished by the next.

A deletion first writes its tombstones, the ids that go; from then on it is bound to happen, and `visible` hides them.
Then each table is written anew without them, one step a table, each marked in the journal when its new version is
whole. Tables and journal are folders that all executors share; versions and marks are Parquet, complete when Spark's
commit is.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Named tables below a folder, each a chain of versions, and the journal of deletions from them.

    keys: for each table the column that deletions go by. `step`, called before each step with its name, is for tests.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Mapping[str, str], step=lambda name: None) -> None:
        self.spark, self.root, self.keys, self.step = spark, root, dict(keys), step

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _listed(self, path: str) -> list[str]:
        """Names of the complete folders below a path; what was being written when a run died has no mark of success."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        place = hadoop(path)
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(place) if fs.exists(hadoop(s.getPath(), "_SUCCESS")))

    def write(self, name: str, df: DataFrame) -> None:
        """df as the next version of a table."""
        last = self._listed(self._path(name))
        number = int(last[-1].split("-")[1]) + 1 if last else 0
        df.write.parquet(self._path(name, f"v-{number:010d}-{uuid.uuid4().hex}"))

    def read(self, name: str) -> DataFrame:
        """The last complete version of a table."""
        versions = self._listed(self._path(name))
        if not versions:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(self._path(name, versions[-1]))

    def _journal(self) -> list[str]:
        """All deletions, in the order in which they began."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        place = hadoop(self._path("journal"))
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def _open(self) -> list[str]:
        """Deletions whose tombstones stand and that are not finished."""
        return [d for d in self._journal() if "tombstones" in (done := self._listed(self._path("journal", d))) and "finished" not in done]

    def _mark(self, deletion: str, name: str) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._path("journal", deletion, name))

    def estimate(self, ids: DataFrame) -> DataFrame:
        """(table, rows): how many rows a deletion of ids (id) would take from each table; nothing is written."""
        out = None
        for name, key in sorted(self.keys.items()):
            n = self.read(name).join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
            out = n if out is None else out.union(n)
        return out

    def delete(self, ids: DataFrame) -> str:
        """Remove ids (id) from every table; returns the deletion's name. Null ids name nothing."""
        deletion = f"d-{len(self._journal()):010d}-{uuid.uuid4().hex}"
        self.step("tombstones")
        ids.select("id").where("id IS NOT NULL").distinct().write.parquet(self._path("journal", deletion, "tombstones"))
        self._finish(deletion)
        return deletion

    def _finish(self, deletion: str) -> None:
        gone = self.spark.read.parquet(self._path("journal", deletion, "tombstones"))
        done = self._listed(self._path("journal", deletion))
        for name, key in sorted(self.keys.items()):
            if name not in done:
                self.step(name)
                self.write(name, self._without(self.read(name), key, gone))
                self.step(f"{name} written")
                self._mark(deletion, name)
        self.step("finished")
        self._mark(deletion, "finished")

    def _without(self, df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
        return df.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(df.columns)

    def reconcile(self) -> list[str]:
        """Finish what killed runs have begun, and return the names of these deletions.

        A step that was done but not marked is done again, which takes nothing more away.
        """
        found = self._open()
        for deletion in found:
            self._finish(deletion)
        return found

    def visible(self, name: str) -> DataFrame:
        """A table as it will be when every deletion that has begun is finished."""
        df = self.read(name)
        for deletion in self._open():
            df = self._without(df, self.keys[name], self.spark.read.parquet(self._path("journal", deletion, "tombstones")))
        return df
