"""One ordered text file per room, visible on commit."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .clouds import _filesystem

SCHEMA = "room string, value string"


@dataclass
class _Files(WriterCommitMessage):
    moves: list[tuple[str, str]] = field(default_factory=list)


def _folder(room: str | None) -> str:
    if not room or "/" in room or room in (".", ".."):
        raise ValueError(f"not a folder name: {room!r}")
    return room


class RoomTextWriter(DataSourceArrowWriter):
    """Streams the sorted rows of a task to one pending file a room; only batches are held.

    Commit gives the files their names, in place of older ones. A failed task removes what it
    began, and other rooms' files stay as they are.
    """

    def __init__(self, path: str, file: str):
        self.path, self.file = path, file

    def write(self, iterator) -> WriterCommitMessage:
        system, root = _filesystem(self.path)
        made = _Files()
        now, out = None, None
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                rooms = table["room"].to_pylist()
                values = table["value"].to_pylist()
                at = 0
                while at < len(rooms):
                    end = at + 1
                    while end < len(rooms) and rooms[end] == rooms[at]:
                        end += 1
                    if rooms[at] != now or out is None:
                        if out is not None:
                            out.close()
                        now = rooms[at]
                        folder = f"{root}/{_folder(now)}"
                        system.create_dir(folder, recursive=True)
                        made.moves.append((f"{folder}/.{self.file}.{uuid.uuid4().hex}", f"{folder}/{self.file}"))
                        out = system.open_output_stream(made.moves[-1][0])
                    out.write("".join(f"{v}\n" for v in values[at:end]).encode())
                    at = end
        except BaseException:
            if out is not None:
                out.close()
            self.abort([made])
            raise
        if out is not None:
            out.close()
        return made

    def commit(self, messages) -> None:
        system, _ = _filesystem(self.path)
        for part in messages:
            for pending, final in part.moves if part else ():
                system.move(pending, final)

    def abort(self, messages) -> None:
        system, _ = _filesystem(self.path)
        for part in messages:
            for pending, _ in part.moves if part else ():
                system.delete_file(pending)


class RoomTextSource(DataSource):
    """`df.write.format("roomtext").option("file", name).mode("append").save(path)` for `(room, value)` rows."""

    @classmethod
    def name(cls) -> str:
        return "roomtext"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RoomTextWriter(self.options["path"], self.options["file"])


def write_room_files(lines: DataFrame, path: str, file: str, order: list[str | Column], value: str = "value") -> None:
    """`<path>/<room>/<file>` with the values of each room, one a line, by `order`.

    A room is one file and so one task's stream; rooms spread over the tasks.
    """
    spark = lines.sparkSession
    spark.dataSource.register(RoomTextSource)
    dealt = lines.repartition(F.col("room").cast("string")).sortWithinPartitions(F.col("room").cast("string"), *order)
    dealt.select(F.col("room").cast("string").alias("room"), F.col(value).alias("value")).write.format("roomtext").option(
        "file", file
    ).mode("append").save(path)
