"""A sink of text files that executors write and that appear together or not at all.

Rows ``(file, ord, line)`` are dealt by file and sorted within, so a task streams
its files line by line. A task writes under names of its own and reports them; the
driver's commit gives files their names, and an abort, or a task that was lost,
leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from graphloom.sources.folder import place


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are, and what they are to be called."""

    files: list[tuple[str, str]]


class LineFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return "file string, ord string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LineWriter(self.options["root"])


class LineWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root, self.job = root.rstrip("/"), f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, base = place(self.root)
        system.create_dir(f"{base}/{self.job}", recursive=True)
        done: list[tuple[str, str]] = []
        out = None
        try:
            for row in iterator:
                if not done or done[-1][1] != row["file"]:
                    if out is not None:
                        out.close()
                    done.append((f"{self.job}/{uuid.uuid4().hex}", row["file"]))
                    out = system.open_output_stream(f"{base}/{done[-1][0]}")
                out.write((row["line"] + "\n").encode("utf-8", "replace"))
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        system, base = place(self.root)
        for m in messages:
            for at, name in m.files if m else ():
                if "/" in name:
                    system.create_dir(f"{base}/{name.rsplit('/', 1)[0]}", recursive=True)
                system.move(f"{base}/{at}", f"{base}/{name}")
        self._clear(system, base)

    def abort(self, messages: list) -> None:
        self._clear(*place(self.root))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


def write(lines: DataFrame, root: str) -> None:
    """``lines(file, ord, line)``: each file's lines in order of ``ord`` below ``root``; files of the same names are replaced."""
    spark = lines.sparkSession
    spark.dataSource.register(LineFiles)
    dealt = lines.selectExpr("file", "cast(ord as string) as ord", "line").repartition("file").sortWithinPartitions("file", "ord")
    dealt.write.format("line_files").option("root", root).mode("append").save()
