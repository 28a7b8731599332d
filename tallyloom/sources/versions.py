"""Tables published as immutable versions.

A version is a folder of Parquet files that nobody writes again, and a numbered entry that names it. The entry is what
publishes: it is written aside and renamed to its number, which succeeds for one writer only (a rename onto a folder that
is there fails or moves into it, which is undone), so readers see the version before or the one after, whole, and a
writer that stops halfway leaves nothing that is read. Writers that build on a version name it, and fail if another has been
published since (optimistic concurrency).

The rename is atomic on HDFS and local disks. On an object store, where it is a copy, numbers need a store whose
connector can create a key only if it is absent.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another version was published since the one that a writer built on."""


class Folder:
    """Files of a folder in any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def entries(self, name: str = "") -> list[tuple[str, int]]:
        """Names of what lies in a folder, and when each was last changed (milliseconds); none if it isn't there."""
        if not self.exists(name):
            return []
        return sorted((f.getPath().getName(), f.getModificationTime()) for f in self._fs.listStatus(self._at(name)))

    def matching(self, pattern: str) -> list[str]:
        """Paths of what fits a pattern with stars."""
        return sorted(f.getPath().toString() for f in self._fs.globStatus(self._at(pattern)) or [])

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, fresh: str, name: str) -> bool:
        """Gives a finished folder its name; False, and the folder is gone, if the name is taken."""
        inner = fresh.rpartition("/")[2]
        if not self.exists(name) and self._fs.rename(self._at(fresh), self._at(name)):
            if not self.exists(f"{name}/{inner}"):
                return True
            self.delete(f"{name}/{inner}")  # another one came first, and the rename moved into its folder
        self.delete(fresh)
        return False


class Versions:
    """Versions of one table in a folder: entries under v, files under data."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def numbers(self) -> list[int]:
        return [int(name) for name, _ in self.folder.entries("v") if name.isdigit()]

    def current(self) -> int:
        """The last version; 0 if nothing is published."""
        return max(self.numbers(), default=0)

    def entry(self, number: int) -> dict:
        return json.loads(self.folder.read(f"v/{number:012d}/entry.json"))

    def read(self, number: int | None = None) -> DataFrame:
        """A version, the last one if none is named; later versions don't change what was read."""
        number = number or self.current()
        if not number:
            raise LookupError(f"nothing is published in {self.folder.path}")
        entry = self.entry(number)
        return self.spark.read.schema(entry["schema"]).parquet(f"{self.folder.path}/data/{entry['data']}")

    def publish(self, rows: DataFrame, based_on: int | None = None, note: str = "", allow_empty: bool = False) -> int:
        """Writes rows as the next version and returns its number.

        based_on: the version that rows were made from; if another one has been published since, Conflict is raised and
        nothing changes. Without it the next free number is taken. An empty table is refused, so that old data stays.
        """
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder.path}/data/{data}")
        if not allow_empty and self.spark.read.schema(rows.schema).parquet(f"{self.folder.path}/data/{data}").isEmpty():
            self.folder.delete(f"data/{data}")
            raise ValueError("refusing to publish an empty table")
        entry = json.dumps({"data": data, "schema": rows._jdf.schema().toDDL(), "based_on": based_on, "note": note})
        while True:
            last = self.current()
            if based_on is not None and last != based_on:
                self.folder.delete(f"data/{data}")
                raise Conflict(f"built on version {based_on}, but {last} is published")
            self.folder.write(f"new/{data}/entry.json", entry)
            self.folder.make("v")
            if self.folder.claim(f"new/{data}", f"v/{last + 1:012d}"):
                return last + 1

    def vacuum(self, keep: int, grace_ms: int, now_ms: int) -> int:
        """Deletes what is older than the grace: all versions but the last ``keep``, and files that no version names.

        The grace must be longer than any read or write takes. The number of folders deleted is returned.
        """
        numbers = self.numbers()
        held = {n: self.entry(n)["data"] for n in numbers}
        old = {f"{n:012d}": n for n in numbers[: max(0, len(numbers) - max(1, keep))]}
        gone = 0
        for name, changed in self.folder.entries("v"):
            if name in old and now_ms - changed > grace_ms:
                self.folder.delete(f"v/{name}")
                del held[old[name]]
        for name, changed in self.folder.entries("data"):
            if name not in held.values() and now_ms - changed > grace_ms:
                self.folder.delete(f"data/{name}")
                gone += 1
        return gone
