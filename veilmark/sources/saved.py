"""Datasets saved as folders of Arrow files: a data source with one partition a file, and the writer that makes such folders.

A folder has ``state.json``, which lists its data files and carries a fingerprint, and the files themselves, each an Arrow stream. A folder of several
splits has ``dataset_dict.json`` and a folder for each. Files are read a record batch at a time and only the asked-for columns
(option ``columns``) are decoded into rows. Paths may have a scheme that Arrow's file systems know.

Writing gives each task a file of its own name; ``state.json`` lists the files of tasks that were committed, so what a lost task left behind is not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "saved_dataset"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _json(path: str, name: str) -> dict | None:
    system, root = _open(path)
    file = f"{root.rstrip('/')}/{name}"
    if system.get_file_info(file).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(file) as f:
        return json.loads(f.read())


def split_folder(path: str, split: str | None) -> str:
    """The folder of a split; ``ValueError`` if there is none."""
    splits = (_json(path, "dataset_dict.json") or {}).get("splits")
    if splits is None:
        return path
    if split is None and len(splits) == 1:
        split = splits[0]
    if split not in splits:
        raise ValueError(f"no split {split!r} in {path}; there are {splits}")
    return f"{path.rstrip('/')}/{split}"


def fingerprint(path: str, split: str | None = None) -> str | None:
    return (_json(split_folder(path, split), "state.json") or {}).get("_fingerprint")


def _files(folder: str) -> list[str]:
    state = _json(folder, "state.json")
    if state is None:
        raise ValueError(f"{folder} is no saved dataset")
    return [f["filename"] for f in state.get("_data_files", [])]


@dataclass
class ArrowFile(InputPartition):
    name: str


class SavedDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _folder(self) -> str:
        return split_folder(self.options["path"], self.options.get("split"))

    def _columns(self) -> list[str] | None:
        return json.loads(self.options["columns"]) if "columns" in self.options else None

    def schema(self) -> StructType:
        folder = self._folder()
        files = _files(folder)
        if not files:
            info = _json(folder, "dataset_info.json") or {}
            return StructType.fromJson(info["spark_schema"]) if "spark_schema" in info else StructType()
        system, root = _open(folder)
        with system.open_input_stream(f"{root.rstrip('/')}/{files[0]}") as f:
            kind = from_arrow_schema(pa.ipc.open_stream(f).schema)
        wanted = self._columns()
        if wanted is None:
            return kind
        if missing := [c for c in wanted if c not in kind.fieldNames()]:
            raise ValueError(f"no columns {missing} in {folder}")
        return StructType([kind[c] for c in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._folder(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, schema

    def partitions(self) -> list[ArrowFile]:
        return [ArrowFile(name) for name in _files(self.folder)] or [ArrowFile("")]

    def read(self, partition: ArrowFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = _open(self.folder)
        target = to_arrow_schema(self.schema)
        with system.open_input_stream(f"{root.rstrip('/')}/{partition.name}") as f:
            for batch in pa.ipc.open_stream(f):
                yield from pa.Table.from_batches([batch]).select(target.names).cast(target).to_batches()


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema_json, self.overwrite = path, schema.jsonValue(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _open(self.path)
        name, rows, out, sink = f"data-{uuid.uuid4().hex}.arrow", 0, None, None
        for batch in iterator:
            if out is None:
                system.create_dir(root, recursive=True)
                sink = system.open_output_stream(f"{root.rstrip('/')}/{name}")
                out = pa.ipc.new_stream(sink, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
            sink.close()
        return _Written(name if out is not None else None, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files = sorted(m.name for m in messages if m is not None and m.name)
        if not self.overwrite:
            files = [*((f["filename"] for f in (_json(self.path, "state.json") or {}).get("_data_files", []))), *files]
        mark = hashlib.sha256("\n".join(files).encode()).hexdigest()[:16]
        rows = sum(m.rows for m in messages if m is not None)
        for name, value in (("dataset_info.json", {"spark_schema": self.schema_json, "rows_written": rows}), ("state.json", {"_data_files": [{"filename": f} for f in files], "_fingerprint": mark, "_split": None})):
            with system.open_output_stream(f"{root.rstrip('/')}/{name}") as f:
                f.write(json.dumps(value).encode())

    def abort(self, messages) -> None:
        """Files of tasks that were not committed are in no list; nothing is to be undone."""


def register(spark: SparkSession) -> None:
    from veilmark import ship

    ship(spark)
    spark.dataSource.register(SavedDataset)


def read_saved(spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(FORMAT)
    for name, value in (("split", split), ("columns", None if columns is None else json.dumps(columns))):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(path)


def write_saved(df: DataFrame, path: str, overwrite: bool = True) -> None:
    register(df.sparkSession)
    df.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def write_splits(splits: dict[str, DataFrame], path: str) -> None:
    """A folder of several splits."""
    for name, df in splits.items():
        write_saved(df, f"{path.rstrip('/')}/{name}")
    system, root = _open(path)
    with system.open_output_stream(f"{root.rstrip('/')}/dataset_dict.json") as f:
        f.write(json.dumps({"splits": list(splits)}).encode())
