"""Replacing the folders of a dataset's days as a whole, and what was seen while they were written.

New rows go to a folder beside the days. Only when all of them are written are the old folders moved aside
and the new ones moved in, one rename each; whatever fails before that leaves every old day as it was, and
a failing rename puts the old folder back. Readers pass over the folder, as its name starts with a line.
One job at a time may replace days of a dataset, or several that have no day in common.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SWAP = "_swap-"


class Files:
    """The few file-system calls that a swap takes, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, *inside: str) -> list[str]:
        folder = self._path("/".join([self.root, *inside]))
        return [s.getPath().getName() for s in self._system.listStatus(folder)] if self._system.exists(folder) else []

    def move(self, one: tuple[str, ...], other: tuple[str, ...]) -> None:
        source, target = (self._path("/".join([self.root, *p])) for p in (one, other))
        self._system.mkdirs(target.getParent())
        if not self._system.rename(source, target):
            raise OSError(f"can't move {source} to {target}")

    def write(self, content: bytes) -> None:
        """The root itself as a file of these bytes."""
        stream = self._system.create(self._path(self.root), True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    @staticmethod
    def plain(name: str) -> str:
        """A partition folder's value as it was before signs were escaped for the folder's name."""
        return unquote(name)

    def delete(self, *inside: str) -> None:
        self._system.delete(self._path("/".join([self.root, *inside])), True)


def replace_days(
    spark: SparkSession, path: str, write: Callable[[str], None], days: Iterable[dt.date] = (), *, day: str = "day"
) -> None:
    """Let ``write`` fill a new folder with ``day=`` folders, then put these in the place of the old ones.

    ``days`` that got no rows lose their old folder too. If ``write`` raises, nothing changes.
    """
    files, swap = Files(spark, path), f"{_SWAP}{uuid.uuid4().hex}"
    try:
        write(f"{files.root}/{swap}/new")
        made = [n for n in files.names(swap, "new") if n.startswith(f"{day}=")]
        there = set(files.names())
        for name in sorted({*made, *(f"{day}={d.isoformat()}" for d in days)}):
            if name in there:
                files.move((name,), (swap, "old", name))
            if name in made:
                try:
                    files.move((swap, "new", name), (name,))
                except Exception:
                    if name in there:
                        files.move((swap, "old", name), (name,))
                    raise
    finally:
        files.delete(swap)


def restore_days(spark: SparkSession, path: str) -> list[str]:
    """Put back the days that a driver lost half-way through a swap had moved aside; returns their names."""
    files, back = Files(spark, path), []
    for swap in [n for n in files.names() if n.startswith(_SWAP)]:
        for name in files.names(swap, "old"):
            if name not in files.names():
                files.move((swap, "old", name), (name,))
                back.append(name)
        files.delete(swap)
    return back


def observed(rows: DataFrame, days: list[dt.date], bad_line: str, *, day: str = "day") -> tuple[DataFrame, Observation]:
    """The rows, and what will be known per day once they are written: rows and unreadable lines, without another scan."""
    seen, of = Observation(), F.col(day)
    counts = [F.count_if(of == F.lit(d)).alias(f"rows_{i}") for i, d in enumerate(days)]
    counts += [F.count_if((of == F.lit(d)) & F.col(bad_line).isNotNull()).alias(f"bad_{i}") for i, d in enumerate(days)]
    return rows.observe(seen, *counts), seen


def counts_of(seen: Observation, days: list[dt.date]) -> dict[dt.date, tuple[int, int]]:
    """(rows, unreadable lines) of each day; call it after the action."""
    found = seen.get
    return {d: (found.get(f"rows_{i}", 0), found.get(f"bad_{i}", 0)) for i, d in enumerate(days)}


def unreadable(error: Exception) -> bool:
    """Whether reading a file failed, for good or for the moment."""
    return bool(re.search("FAILED_READ_FILE|EOFException|ZipException", str(error)))


def reason(error: Exception) -> str:
    """What went wrong at the bottom of a failed job, and the file's name where it is told."""
    java, last = getattr(error, "java_exception", None) or getattr(error, "_origin", None), None
    while java is not None:
        last, java = java, java.getCause()
    message = f"{last.getClass().getSimpleName()}: {last.getMessage()}" if last is not None else str(error).splitlines()[0]
    file = re.search(r"reading file:? ?(\S+?)[.,]?\s", str(error))
    return (message + (f" ({file[1]})" if file and file[1] not in message else ""))[:500]
