"""Publishing whole: data is written aside, then one exclusively created file claims its number, and folders are renamed.

Whoever comes next finishes the renames of a claim whose writer was lost, so a claim is a commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomlog.errors import LogError


class Folder:
    """A folder of numbered parts on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._at(f"{self.path}/{name}" if name else self.path))

    def names(self, start: str) -> list[str]:
        if not self.exists():
            return []
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._at(self.path)) if x.getPath().getName().startswith(start))

    def aside(self, df: DataFrame) -> str:
        """Writes `df` where no reader looks; the folder's name."""
        name = f"_aside-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.path}/{name}")
        except Exception:
            self.remove(name)
            raise
        return name

    def remove(self, *names: str) -> None:
        for name in names:
            self._files.delete(self._at(f"{self.path}/{name}"), True)

    def publish(self, number: int, moves: dict[str, str]) -> None:
        """Renames folders (from, to) together under the claim `number`; a number that is claimed already is a conflict, and nothing is renamed."""
        claim = f"_claim-{number:020}"
        try:
            out = self._files.create(self._at(f"{self.path}/{claim}"), False)
        except Exception as e:
            self.remove(*moves)
            raise LogError("conflict", "another writer was first", "publish", number=number) from e
        out.write(bytearray(json.dumps(moves).encode()))
        out.close()
        self._finish(moves)

    def move(self, name: str, to: str) -> None:
        """Renames a folder; what is there under its new name goes."""
        if self.exists(to):
            self.remove(to)
        self._files.mkdirs(self._at(f"{self.path}/{to}").getParent())
        self._files.rename(self._at(f"{self.path}/{name}"), self._at(f"{self.path}/{to}"))

    def _finish(self, moves: dict[str, str]) -> None:
        for a, b in moves.items():
            if self.exists(a):
                self.move(a, b)

    def recover(self) -> int:
        """Finishes the newest claim; its number, 0 without one."""
        claims = self.names("_claim-")
        if not claims:
            return 0
        if said := self._read(claims[-1]):
            self._finish(json.loads(said))
        return int(claims[-1].removeprefix("_claim-"))

    def _read(self, name: str) -> str:
        stream = self._files.open(self._at(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
