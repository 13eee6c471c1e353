"""Token counts kept up to date by signed deltas: additive totals by source, language and tokenizer version."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import slices

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def byte_bpe_counter(path: str, pattern: str) -> Callable[[], Callable[[str], int]]:
    """A counter for with_token_counts, made once in each task from a file of ranks."""

    def make() -> Callable[[str], int]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return make


def with_token_counts(docs: DataFrame, counter: Callable[[], Callable[[str], int]], text_cols: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of docs, and for each text column c a long `c_tokens`; null texts have none. Texts leave no task."""
    narrow = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *(F.col(c).alias(f"t{i}") for i, c in enumerate(text_cols)))
    types = dict(narrow.dtypes)
    schema = ", ".join([*(f"k{i} {types[f'k{i}']}" for i in range(len(keep))), *(f"n{i} long" for i in range(len(text_cols)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for b in slices(batches, "t0"):
            counts = [pa.array([count(t) if t else 0 for t in b.column(f"t{i}").to_pylist()], pa.int64()) for i in range(len(text_cols))]
            yield pa.record_batch([*(b.column(f"k{i}") for i in range(len(keep))), *counts], [*(f"k{i}" for i in range(len(keep))), *(f"n{i}" for i in range(len(text_cols)))])

    return narrow.mapInArrow(run, schema).toDF(*keep, *(f"{c}_tokens" for c in text_cols))


def deltas(rows: DataFrame, version: str, docs: Column, tokens: Column) -> DataFrame:
    """Signed changes of the totals from rows with source and lang: +1 and the count for an insert, -1 and minus the count for a
    delete, 0 and the difference for a revised count. Null sources and languages are keys of their own; a null count adds nothing; repeated
    rows count as often as they come; an empty table gives an empty result."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder of committed batches. A batch's rows are summed by key before they are written, so the folder grows
    with keys and batches, not with documents; a batch that is committed again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._p = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._p(f"{self.path}/batch={batch}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of deltas; False if it was there already. It is written aside and renamed, so it counts whole or not at all."""
        if self.committed(batch):
            return False
        aside = f"{self.path}/_new/{batch}"
        changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.mode("overwrite").parquet(aside)
        self._fs.delete(self._p(f"{self.path}/batch={batch}"), True)
        if not self._fs.rename(self._p(aside), self._p(f"{self.path}/batch={batch}")):
            raise RuntimeError(f"batch {batch} could not be committed")
        return True

    def totals(self) -> DataFrame:
        """One row a key that still has documents or tokens; null sources and languages are keys like others."""
        paths = [str(s.getPath()) for s in self._fs.globStatus(self._p(f"{self.path}/batch=*")) or [] if self._fs.exists(self._p(f"{s.getPath()}/_SUCCESS"))]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")
