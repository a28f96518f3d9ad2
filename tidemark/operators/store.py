"""Versioned Parquet tables: a commit writes a new version, then swaps the pointer in one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Table:
    """A table at a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        """The pointer's content: the version, and for each stream the last batch that is in it."""
        jvm, at, fs = self._fs()
        if not fs.util().exists(at):
            return {"version": None, "batches": {}}
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> str | None:
        return self._current()["version"]

    def holds(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream has been committed."""
        return self._current()["batches"].get(stream, -1) >= batch

    def read(self) -> DataFrame:
        """The committed version; no rows before the first commit."""
        if (v := self.version()) is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}")

    def commit(self, rows: DataFrame, stream: str | None = None, batch: int = -1) -> str:
        """Write ``rows`` in full, then make them the current version; readers see the old version or the new one.

        The batch of a stream that the rows come from is kept with the version, in the same swap. If another version has
        become current while the rows were written, they are not committed: they may have been made from an old one.
        """
        before = self._current()
        batches = before["batches"] | ({} if stream is None else {stream: batch})
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/{version}")
        if (now := self.version()) != before["version"]:
            raise RuntimeError(f"another commit has made {now} current")
        jvm, at, fs = self._fs()
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.CURRENT-{version}")
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
        out = fs.create(draft, flags, options)
        out.write(bytearray(json.dumps({"version": version, "batches": batches}).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        fs.rename(draft, at, over)
        return version
