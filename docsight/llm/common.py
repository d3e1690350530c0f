"""What the operators of this subpackage share: checkpoints, streams, null-safe keys."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and all runs in one process.

    On a cluster without a shared folder this raises: executors could not read one another's files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return path or held.get()
    if not path and not sc.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = path or tempfile.mkdtemp(prefix="docsight-checkpoints-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cost no lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The table, written as Parquet to the shared checkpoint folder and read again: smaller than ``cut``, and read by columns."""
    at = f"{checkpoint_dir(df.sparkSession)}/docsight-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def utf8(column: str) -> Column:
    """The text as bytes: Python then neither decodes nor fails on broken UTF-8."""
    return F.col(column).cast("binary")


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves the remainder; a null id is never held out."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == remainder, F.lit(False))


def hash_share(n: int, bound: int, *columns: str) -> Column:
    """A filter that takes about ``bound`` of ``n`` rows, the same ones in every run."""
    space = 1 << 30
    keep = space if n <= bound else max(1, space * bound // n)
    return F.pmod(F.xxhash64(*columns), F.lit(space)) < keep


def text_slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        upto = max(at + 1, upto)
        yield batch.slice(at, upto - at)
        at = upto


def once_a_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept as long as the Python worker lives: this package's own globals come anew with each task."""
    held = sys.modules.setdefault("_docsight_worker", ModuleType("_docsight_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Memo:
    """Values by string, made in bulk, in two generations of about ``most`` characters: common ones survive."""

    def __init__(self, make: Callable[[list[str]], list], most: int):
        self.make, self.most = make, most
        self.now: dict[str, Any] = {}
        self.before: dict[str, Any] = {}
        self.held = 0

    def learn(self, keys: set[str]) -> Callable[[str], Any]:
        """A function that gives the value of each of the keys, up to the next call."""
        if self.held > self.most:
            self.before, self.now, self.held = self.now, {}, 0
        now, before = self.now, self.before
        new = [k for k in keys if k not in now]
        now.update((k, before[k]) for k in new if k in before)
        fresh = [k for k in new if k not in before]
        if fresh:
            now.update(zip(fresh, self.make(fresh), strict=True))
        self.held += sum(map(len, new))
        return self.now.__getitem__


def words_between_spaces(text: str) -> list[str] | None:
    """The words of a text with single spaces between them; None if a space may stand beside other white space or an end."""
    words = text.split(" ")
    return None if "" in words or any(map(str.isspace, {w[0] for w in words})) else words
