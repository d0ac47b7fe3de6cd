"""A sink of files by name that appear together or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """A task's staged files and the names that they will have."""

    files: list[tuple[str, str]]


class PageWriter(DataSourceWriter):
    """Tasks write below a folder of the job. The commit moves what the successful attempts wrote to its place, and then writes ``_SUCCESS``; what failed or repeated attempts wrote goes with the folder."""

    def __init__(self, path: str, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.folder = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        store, folder = _store(self.folder)
        task = f"{folder}/{uuid.uuid4().hex}"
        store.create_dir(task, recursive=True)
        files = []
        for k, row in enumerate(rows):
            name = row["name"]
            if not name or "/" in name or name in (".", "..") or name.startswith("_"):
                raise ValueError(f"a page cannot be named {name!r}")
            at = f"{task}/{k}"
            with store.open_output_stream(at) as f:
                f.write((row["value"] or "").encode())
            files.append((at, name))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _store(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("two pages have one name")
            if self.overwrite:
                for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                    if not info.base_name.startswith("_staging-"):
                        (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda f: store.move(f[0], f"{root}/{f[1]}{self.suffix}"), files))
        finally:
            self.abort(messages)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        store, folder = _store(self.folder)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class PageSink(DataSource):
    """``df.write.format("pages")`` of ``name, value`` with the options ``path`` and ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], self.options.get("suffix", ".html"), overwrite)


def write_pages(df: DataFrame, path: str, name: Column, value: Column, suffix: str = ".html") -> None:
    """One file a row, in place of all files at ``path``: either all are there and ``_SUCCESS`` with them, or none of them is.

    Names must be distinct. ``path`` is one that the driver and all executors share. Null values give empty files; null names are an error.
    """
    df.sparkSession.dataSource.register(PageSink)
    df.select(name.cast("string").alias("name"), value.cast("string").alias("value")).write.format("pages").option("path", path).option("suffix", suffix).mode("overwrite").save()
