"""Folders of tables on whatever file system the cluster has, and the store of all tables."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from knowloom.operators import fts, merge
from knowloom.schemas import TABLES, empty


class Folders:
    """Listing, renaming and deleting of folders through the cluster's own file system client."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} could not be renamed to {new}")


class Versions:
    """One table as versioned Parquet folders: a version counts when it is written whole; the two last ones are kept."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name, self.folders = spark, path, name, Folders(spark)

    def _numbers(self) -> list[int]:
        whole = (d for d in self.folders.children(self.path) if d[:1] == "v" and d[1:].isdigit())
        return sorted(int(d[1:]) for d in whole if self.folders.exists(f"{self.path}/{d}/_SUCCESS"))

    def load(self) -> DataFrame:
        v = self._numbers()
        return self.spark.read.schema(TABLES[self.name][0]).parquet(f"{self.path}/v{v[-1]}") if v else empty(self.spark, self.name)

    def store(self, table: DataFrame) -> None:
        v = self._numbers()
        new = (v[-1] if v else 0) + 1
        self.folders.delete(f"{self.path}/v{new}")
        table.select(*TABLES[self.name][0].names).write.parquet(f"{self.path}/v{new}")
        for old in v[:-1]:
            self.folders.delete(f"{self.path}/v{old}")


class DataStore(Protocol):
    """Where the stages keep their tables; ``Store`` is the one on Parquet folders."""

    spark: SparkSession

    def read(self, name: str) -> DataFrame: ...

    def write(self, name: str, df: DataFrame) -> None: ...

    def upsert(self, name: str, rows: DataFrame) -> None: ...

    def upsert_messages(self, messages: DataFrame) -> None: ...


class Store:
    """All tables below one folder.  A reader sees the last whole version, also if a writer is lost."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{name}", name)

    def read(self, name: str) -> DataFrame:
        return self._table(name).load()

    def write(self, name: str, df: DataFrame) -> None:
        self._table(name).store(df)

    def upsert(self, name: str, rows: DataFrame) -> None:
        old = self.read(name)
        self.write(name, merge.merge_registry(old, rows) if name == "content_registry" else merge.last_wins(old, rows, TABLES[name][1]))

    def index(self) -> tuple[DataFrame, DataFrame]:
        """The full-text index of the messages."""
        return self.read("postings"), self.read("message_lengths")

    def upsert_messages(self, messages: DataFrame) -> None:
        """Messages and their full-text index."""
        self.upsert("messages", messages)
        for name, df in zip(("postings", "message_lengths"), fts.upsert_postings(self.index(), messages)):
            self.write(name, df)


def count_batches(totals: Iterable[dict[str, int]]) -> dict[str, int]:
    """Sum of the counters of several batches."""
    out: dict[str, int] = {}
    for t in totals:
        for k, n in t.items():
            out[k] = out.get(k, 0) + n
    return out
