"""Tables that take upserts in batches: a log of versions, each put if absent, over Parquet files that are never changed."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer put the version first, more often than this one was ready to try."""


def exists_already(e: Py4JJavaError) -> bool:
    return "FileAlreadyExistsException" in str(e.java_exception.getClass().getName())


@dataclass
class Version:
    number: int
    parts: list[tuple[str, int]]  # folder and the version that added it; the first may be a snapshot
    batches: list[str]


class UpsertTable:
    """Rows by key, with the last value given for each column.

    A batch is written as a folder of its own first; it counts from the moment when a small file with the next version's number is in place,
    which a rename that does not overwrite grants to one writer only. A writer that comes second reads the new version and tries the next number. A batch
    whose id is in the log changes nothing, so a job may be sent again after any failure. `compacted` replaces what has gathered by one snapshot.

    A change gives a value for the columns in its `present` (all if that is null): a null in one of these empties the column, and others stay as
    they were. Rows have `first_seen` and `last_seen`, the versions that made and last touched them. Rows with a null in the key are left out; of rows
    of one batch with one key the last by `order` counts, column by column.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: str, buckets: int = 16, tries: int = 20, patience: float = 10.0):
        self.spark, self.path, self.keys, self.order, self.buckets, self.tries, self.patience = spark, path.rstrip("/"), list(keys), order, buckets, tries, patience
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number: int, kind: str = "json"):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{number:012d}.{kind}")

    def version(self) -> Version:
        """The last version there is."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not self._fs.exists(folder):
            return Version(0, [], [])
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        last = max((n for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=None)
        if last is None:
            return Version(0, [], [])
        stream = self._fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{last}"))
        try:
            said = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Version(said["number"], [tuple(p) for p in said["parts"]], said["batches"])

    def _claimed(self, number: int) -> bool:
        try:
            self._fs.create(self._file(number, "claim"), False).close()
            return True
        except Py4JJavaError as e:
            if not exists_already(e):
                raise
            return False

    def _put(self, v: Version) -> bool:
        """Put the version's file in place whole, unless it is there; false if another writer's is.

        One writer has the claim and the others wait for its file; if none appears (it died), the first to rename its own takes the number.
        """
        if not self._claimed(v.number):
            until = time.monotonic() + self.patience
            while time.monotonic() < until:
                if self._fs.exists(self._file(v.number)):
                    return False
                time.sleep(0.05)
        jvm = self.spark._jvm
        whole = self._file(v.number, f"{uuid.uuid4().hex}.tmp")
        out = self._fs.create(whole, False)
        out.write(bytearray(json.dumps({"number": v.number, "parts": v.parts, "batches": v.batches}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(whole, self._file(v.number), none)
        except Py4JJavaError as e:
            if not exists_already(e):
                raise
            self._fs.delete(whole, False)
            return False
        return True

    def _logged(self, change: Callable[[Version], Version | None]) -> Version:
        for _ in range(self.tries):
            now = self.version()
            new = change(now)
            if new is None or self._put(new):
                return new or now
        raise Conflict(self.path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; false if it is in the log already."""
        if batch in self.version().batches:
            return False
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = changes if "present" in changes.columns else changes.withColumn("present", F.lit(None).cast("array<string>"))
        rows.dropna(subset=self.keys).repartition(self.buckets, *self.keys).write.parquet(folder)
        before = self.version()
        done = self._logged(lambda v: None if batch in v.batches else Version(v.number + 1, [*v.parts, (folder, v.number + 1)], [*v.batches, batch]))
        return done.number > before.number and any(p[0] == folder for p in done.parts)

    def _states(self, v: Version) -> DataFrame | None:
        """One struct a column: where it was last given, and its value."""
        out = None
        for folder, number in v.parts:
            part = self.spark.read.parquet(folder)
            if "first_seen" not in part.columns:
                columns = [c for c in part.columns if c not in (*self.keys, "present")]
                at = F.struct(F.lit(number).cast("long").alias("version"), F.col(self.order).alias("order"))
                given = lambda c: F.col("present").isNull() | F.array_contains("present", c)
                part = part.select(*self.keys, *(F.when(given(c), F.struct(at.alias("at"), F.col(c).alias("value"))).alias(c) for c in columns), F.lit(number).cast("long").alias("first_seen"), F.lit(number).cast("long").alias("last_seen"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _merged(self, states: DataFrame) -> DataFrame:
        rest = [c for c in states.columns if c not in (*self.keys, "first_seen", "last_seen")]
        return states.groupBy(*self.keys).agg(*(F.max_by(c, F.col(c)["at"]).alias(c) for c in rest), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    def rows(self, v: Version | None = None) -> DataFrame:
        """The table at a version, the last one if none is named."""
        states = self._states(v or self.version())
        if states is None:
            raise ValueError(f"{self.path} has no version yet")
        rest = [c for c in states.columns if c not in (*self.keys, "first_seen", "last_seen")]
        return self._merged(states).select(*self.keys, *(F.col(c)["value"].alias(c) for c in rest), "first_seen", "last_seen")

    def compacted(self) -> Version:
        """Write all rows as one snapshot and log it in place of what it holds; batches that come meanwhile stay behind it. Folders that no version
        before needs any more are left to the caller to delete."""
        start = self.version()
        if len(start.parts) < 2:
            return start
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self._merged(self._states(start)).repartition(self.buckets, *self.keys).write.parquet(folder)

        def change(v: Version) -> Version | None:
            if v.parts[: len(start.parts)] != start.parts:
                return None  # another snapshot was faster
            return Version(v.number + 1, [(folder, start.number), *v.parts[len(start.parts) :]], v.batches)

        return self._logged(change)
