"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    session on one machine that names none (tests) gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="memlake-checkpoint-"))
    return df.checkpoint(eager=True)


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, with underscores until it is none of the frame's columns."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart where ids may be null or come with several texts: a hash of id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def give_back() -> None:
    """Return what a Python worker has freed to the machine: workers live through many tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
