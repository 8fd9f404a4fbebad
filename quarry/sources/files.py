"""Files by path or URI in Python readers and writers."""

from __future__ import annotations

import math

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store, the path inside it, and what stands before such paths: of a plain path, or a URI of any store that Arrow reaches."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return *fs.FileSystem.from_uri(path), path.split("://")[0] + "://"
    return fs.LocalFileSystem(), path, ""


def open_input(path: str):
    """A seekable file."""
    store, inner, _ = _store(path)
    return store.open_input_file(inner)


def listed(path: str) -> list[str]:
    """The path itself, or the files of a directory, by name."""
    store, inner, head = _store(path)
    if store.get_file_info(inner).type == fs.FileType.Directory:
        return sorted(head + x.path for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file and not x.base_name.startswith(("_", ".")))
    return [path]


def write_packed(df: DataFrame, path: str, pack, rows_per_file: int = 100_000) -> int:
    """Writes df in the order of id to a folder of files of about so many rows, each packed (a pandas frame to bytes) by a task of its own; how many rows.

    A task that is run again writes its file again. An empty table makes an empty folder.
    """
    _store(path)[0].create_dir(_store(path)[1])
    ranged = df.repartitionByRange(max(1, math.ceil(df.count() / rows_per_file)), "id").sortWithinPartitions("id")

    def run(batches):
        own = [pdf for pdf in batches if len(pdf)]
        if own:
            store, inner, _ = _store(f"{path}/part-{TaskContext.get().partitionId():05d}")
            whole = pd.concat(own, ignore_index=True)
            with store.open_output_stream(inner) as f:
                f.write(pack(whole))
            yield pd.DataFrame({"n": [len(whole)]})

    return ranged.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
