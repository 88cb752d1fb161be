"""Shared helpers: intermediate tables, literal tables and column checks."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.sources.scratch import shared_folder

#: Words of the contracts: runs without these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the application ends."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(conf).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Cuts the lineage: what follows reads the files, also after executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(conf).delete(hadoop_path, True)


def literal_doubles(values: Iterable[float]) -> Column:
    """A constant array; the optimizer folds the text into one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def literal_json(value: object, kind: str) -> Column:
    """A constant of the given type; the optimizer folds the text into one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def once_per_worker(name: str, make: Callable[[], object]):
    """What ``make`` returned when this Python process first asked for ``name``.

    The package's functions travel to the workers by value, so their globals
    start anew with each task; ``sys`` stays.
    """
    kept = sys.__dict__.setdefault("_packetloom_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a sorted partition, one table per value of ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0][key][0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what the links (i, j) connect, fewer than n."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        low, high = top(a), top(b)
        if low != high:
            parent[low] = high
            out.append((a, b))
    return out


def stars(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``nodes`` to the smallest that the links (i, j) of their places connect them with."""
    order, place = np.unique(nodes, return_inverse=True)
    parent = list(range(len(order)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(place[i].tolist(), place[j].tolist(), strict=True):
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    tops = np.array([top(x) for x in range(len(order))], np.int64)
    own = tops == np.arange(len(order))
    return order[~own], order[tops[~own]]
