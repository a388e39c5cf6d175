"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separator of words: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-separator characters; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


class Kept:
    """Columns that an operator passes on, under names that clash with none of its own; those named like a result give way."""

    def __init__(self, keep: list[str], *results: str) -> None:
        self.names = [c for c in keep if c not in results]
        self.inner = [f"_keep{i}" for i in range(len(self.names))]

    def columns(self) -> list[Column]:
        return [F.col(f"`{c}`").alias(i) for c, i in zip(self.names, self.inner, strict=True)]

    def with_text(self) -> list[Column]:
        """The columns and the text, once."""
        return self.columns() if "text" in self.names else [*self.columns(), F.col("text").alias("_text")]

    @property
    def text(self) -> str:
        """Under what name the text arrives."""
        return self.inner[self.names.index("text")] if "text" in self.names else "_text"

    def restored(self, df: DataFrame, *rest) -> DataFrame:
        return df.select(*[F.col(i).alias(c) for c, i in zip(self.names, self.inner, strict=True)], *rest)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def block_of_row(blocks: int) -> Column:
    """The block a row of documents goes to, by its id, its text and the input partition it is in.

    So of rows that are equal in both, no more than an input partition's share
    a block, however many there are; and a task that is run again sends its
    rows where it sent them before.
    """
    return F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")


def frugal() -> None:
    """What earlier tasks of this worker have freed goes back to the system, and Arrow's memory does when it is freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def array_slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in order, in slices of about `size` bytes, as what is made of them takes many times their room."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def text_slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[list]:
    """array_slices as lists. What is no UTF-8 in a text, which a Parquet file may hold, counts as U+FFFD."""
    for part in array_slices(texts, size):
        try:
            yield part.to_pylist()
        except UnicodeDecodeError:
            yield [x if x is None else x.decode(errors="replace") for x in part.cast(pa.binary()).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; in local mode a temporary one if the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidefold-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class _Open(threading.local):
    """What the open `scratch` blocks of this thread have to delete, innermost last."""

    def __init__(self) -> None:
        self.blocks: list[list[DataFrame]] = []


_OPEN = _Open()


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored(df: DataFrame, name: str, apart: bool = False) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back, which cuts its lineage.

    The files go with `dropped`, at the end of the `scratch` block they were
    written in (`apart`: of the block around that), or else with the session,
    as a result may still need them.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    system, place = _folder(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    owners = _OPEN.blocks[:-1] if apart else _OPEN.blocks
    if owners:
        owners[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that `stored` returned."""
    system, place = _folder(df.sparkSession, df._stored_at)
    system.delete(place, True)


@contextmanager
def scratch():
    """What operators store inside the block is deleted at its end."""
    _OPEN.blocks.append([])
    try:
        yield
    finally:
        for df in _OPEN.blocks.pop():
            dropped(df)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 under links a-b, the smallest node of each one's component (vectorised hooking and jumping)."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped


def components(links: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link to another.

    Alternates the large-star and small-star steps, each of which is a minimum
    per node (combined before the shuffle) and one join, until no link
    changes. Every round is written to the shared folder, so that a lost
    executor costs one round at most. Null ends are ignored.
    """
    pair = F.col
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(pair("u") != pair("v")).distinct()
    e = stored(e, "links")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(pair("v").alias("u"), pair("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(pair("v") > pair("u")).select(pair("v").alias("u"), pair("m").alias("v"))
        large = large.where(pair("u") != pair("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(pair("v").alias("u"), pair("m").alias("v")).unionByName(small.select("u", pair("m").alias("v")))
        new = stored(small.where(pair("u") != pair("v")).distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(e)
        e = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(pair("u").alias("node"), pair("v").alias("component")).unionByName(e.select(pair("v").alias("node"), pair("v").alias("component"))).distinct()
