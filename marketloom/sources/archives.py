"""Archives of text files. Gzip files need nothing here: Spark's readers open .gz. A zip file is one task's work, member by member."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 2_000_000_000


def _members(content: bytes, first_only: bool) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if info.filename and not info.is_dir():
                yield info.filename, z.read(info)
                if first_only:
                    return


def _gunzipped(content: bytes, most: int) -> bytes:
    with gzip.open(io.BytesIO(content)) as f:
        out = f.read(most + 1)
    if not out:
        raise ValueError("the archive is empty")
    if len(out) > most:
        raise ValueError("the archive is too large")
    return out


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unzip(files: DataFrame, first_only: bool = False) -> DataFrame:
    """files: path, content. A row (path, name, content) a member; folders and nameless members are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for name, data in _members(bytes(content), first_only):
                    yield pd.DataFrame({"path": [path], "name": [name], "content": [data]})

    return files.mapInPandas(run, "path string, name string, content binary")


def unzip_lines(files: DataFrame, first_only: bool = False) -> DataFrame:
    """(path, name, line number, value) of every line of text members, a bounded batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for name, data in _members(bytes(content), first_only):
                    lines = data.decode().splitlines()
                    for a in range(0, len(lines), 50_000):
                        part = lines[a : a + 50_000]
                        yield pd.DataFrame({"path": path, "name": name, "number": range(a, a + len(part)), "value": part})

    return files.mapInPandas(run, "path string, name string, number long, value string")


def gunzip(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files: path, content. An empty archive, or one that unpacks to over `most` bytes, is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [_gunzipped(bytes(c), most) for c in pdf["content"]]})

    return files.mapInPandas(run, "path string, content binary")
