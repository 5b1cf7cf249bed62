"""Helpers that the text operators share: folders all executors see, batches of bounded size, column packing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Text bytes that one vectorised step works on; a longer single document is a step of its own.
SLICE_BYTES = 2 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Only a local session may go without: it gets a temporary
    one; on a cluster a machine's own folder would lose data, so it is an error."""
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder, as a URI."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def put_in_place(store, hidden: str, path: str) -> None:
    """Renames a finished file. A store that does not replace files keeps the one that a first run of the task put
    there, which is equal."""
    from pyarrow import fs

    try:
        store.move(hidden, path)
    except OSError:
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(hidden)


def text_array(batch: pa.RecordBatch, name: str = "text") -> pa.LargeStringArray:
    """The column as large strings, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(texts: pa.LargeStringArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [start, end) of at most `most` text bytes, or of one longer text."""
    import numpy as np

    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=texts.offset * 8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def lean(f, keep_pieces: bool = False):
    """f, a function of batches for mapInArrow, which gives memory back to the system when its task ends: a worker
    lives on between tasks, and what its allocators keep counts against the executor."""

    def run(batches):
        import sys

        tokens = sys.modules.get("tessera.llm.token_files")
        if tokens is not None and not keep_pieces:
            tokens._encoders.clear()  # another kind of task left its pieces in this worker
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    import ctypes
    import gc

    import sys

    from tessera.llm import textvec

    textvec.forget()
    blocks = sys.modules.get("tessera.llm.decontaminate")
    if blocks is not None:
        blocks.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it has no such call
        pass

