"""Tables in the folder that all machines share: lineage is cut there, and tasks read blocks of them by themselves."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set on the context.

    Where it is unset, a session on this machine alone takes a temporary one; on a cluster, where
    executors would write to disks of their own, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder or current


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder of its own there."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet, of which later reads take the columns they need."""
    df.write.parquet(folder := new_folder(df.sparkSession, "table"))
    return df.sparkSession.read.parquet(folder)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:/", uri) else os.path.abspath(uri))


#: What this worker made of the last table that fits in one block: its folder and the result.
_LAST: dict[str, Any] = {}


class Spool:
    """A table written to the shared folder, which tasks read in blocks of bounded size.

    It serves where one side must meet every row of the other: nothing of it goes through the
    driver, a task holds one block at a time, and a larger table makes more blocks.
    """

    def __init__(self, df: DataFrame, block_bytes: int):
        self.folder, self.block_bytes = new_folder(df.sparkSession, "spool"), block_bytes
        df.write.option("parquet.block.size", max(block_bytes, 1 << 20)).parquet(self.folder)

    def tables(self, part: int = 0, parts: int = 1) -> Iterator[pa.Table]:
        """The blocks, or those of every ``parts``-th file from the ``part``-th on.

        A row group is written within the block's bytes, and read in batches of an eighth of them, by its rows'
        mean size; so a block holds little more than its bound, or one row where a row is larger.
        """
        system, top = open_fs(self.folder)
        held, size = [], 0
        files = [f for f in sorted(system.get_file_info(fs.FileSelector(top)), key=lambda f: f.path) if f.base_name.endswith(".parquet") and f.base_name[0] not in "._"]
        for info in files[part::parts]:
            with system.open_input_file(info.path) as file:
                parquet = pq.ParquetFile(file)
                for g in range(parquet.num_row_groups):
                    group = parquet.metadata.row_group(g)
                    rows = max(1, self.block_bytes * group.num_rows // (8 * max(group.total_byte_size, 1)))
                    for batch in parquet.iter_batches(batch_size=min(rows, 1 << 16), row_groups=[g]):
                        held.append(batch)
                        size += batch.nbytes
                        if size >= self.block_bytes:
                            yield pa.Table.from_batches(held)
                            held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def blocks(self, make: Callable[[pa.Table], Any]) -> Iterator[Any]:
        """What ``make`` gives for each block; a single block's is kept by the worker for its next tasks."""
        if self.folder in _LAST:
            yield _LAST[self.folder]
            return
        made, n = None, 0
        for n, table in enumerate(self.tables(), 1):
            made = make(table)
            yield made
        if n == 1:
            _LAST.clear()
            _LAST[self.folder] = made
