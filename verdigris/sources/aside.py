"""Files written aside and moved to their place together: what failed shows nowhere.

For formats that Spark has no writer for. The folder must be one that pyarrow can
open on the driver and on all executors.
"""

from __future__ import annotations

import io
import re
import uuid
from abc import abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    rows: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match("[a-z0-9]+:", path) else f"file://{path}")


class AsideWriter(DataSourceWriter):
    """A task's attempt writes into a folder of its own beside `path`. When the job ends, the files of the attempts that count are brought together and take the place of `path` by a rename; without overwrite nothing may stand there."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.aside = f"{self.path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.writing"
        # made here, on the driver, alone: a task that outlives a failed job finds it gone and does not bring it back
        store, aside = opened(self.aside)
        store.create_dir(aside, recursive=True)

    @abstractmethod
    def write_files(self, rows: Iterator[tuple], create: Callable[[str], io.IOBase]) -> int:
        """Writes the rows of a partition to files that create(name) opens; how many rows."""

    @abstractmethod
    def placed(self, files: list[tuple[str, int]]) -> list[tuple[str, str]]:
        """Of all files written (name below the attempts' folder, rows of its attempt) those that count, with their names below `path`; an empty name stands for path itself."""

    def write(self, iterator: Iterator[Row]) -> Attempt:
        store, aside = opened(self.aside)
        name = uuid.uuid4().hex
        store.create_dir(f"{aside}/{name}", recursive=False)

        def create(file: str) -> io.IOBase:
            if "/" in file:
                store.create_dir(f"{aside}/{name}/{file.rsplit('/', 1)[0]}", recursive=True)
            return store.open_output_stream(f"{aside}/{name}/{file}")

        return Attempt(name, self.write_files((tuple(r) for r in iterator), create))

    def commit(self, messages: list[Attempt | None]) -> None:
        store, aside = opened(self.aside)
        target = opened(self.path)[1]
        there = store.get_file_info(target)
        try:
            if there.type != fs.FileType.NotFound and not self.overwrite:
                raise FileExistsError(self.path)
            files = []
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.name):
                found = store.get_file_info(fs.FileSelector(f"{aside}/{m.name}", recursive=True))
                files += [(f.path[len(aside) + 1 :], m.rows) for f in found if f.type == fs.FileType.File]
            places = self.placed(files)
            ready = f"{aside}/ready"
            for name, to in places:
                if to:
                    store.create_dir(f"{ready}/{to}".rsplit("/", 1)[0], recursive=True)
                store.move(f"{aside}/{name}", f"{ready}/{to}" if to else ready)
            if not places:
                store.create_dir(ready)
            if there.type == fs.FileType.Directory:
                store.delete_dir(target)
            store.move(ready, target)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, aside = opened(self.aside)
        if store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_dir(aside)
