"""A log of numbered entries in a shared folder, for writers that may meet."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class CommitLog:
    """Small JSON files ``path/00000001.json`` and so on; a number is given to one writer only.

    An entry is written under another name first and gets its number by a rename that fails where the number is taken, so
    there are no half-written entries. That takes a file system whose renames are atomic, such as HDFS; local files get
    their name by a link.
    """

    path: str

    def put(self, spark: SparkSession, number: int, entry: dict) -> bool:
        """Store entry ``number``, unless there is one already."""
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        hadoop = jvm.org.apache.hadoop.fs
        final = hadoop.Path(f"{self.path}/{number:08d}.json")
        files = final.getFileSystem(conf)
        draft = hadoop.Path(f"{self.path}/_{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if files.getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                rename = getattr(hadoop, "Options$Rename")
                context = hadoop.FileContext.getFileContext(files.getUri(), conf)
                context.rename(files.makeQualified(draft), files.makeQualified(final), spark._sc._gateway.new_array(rename, 0))
        except FileExistsError:
            return False
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            return False
        finally:
            files.delete(draft, False)
        return True

    def entries(self, spark: SparkSession) -> dict[int, dict]:
        """All entries by number."""
        return {number: self._read(spark, number) for number in self._numbers(spark)}

    def newest(self, spark: SparkSession) -> tuple[int, dict | None]:
        """The last entry and its number, 0 and None where there is none."""
        number = max(self._numbers(spark), default=0)
        return number, self._read(spark, number) if number else None

    def _folder(self, spark: SparkSession):
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self, spark: SparkSession) -> list[int]:
        folder, files = self._folder(spark)
        if not files.exists(folder):
            return []
        names = (status.getPath().getName() for status in files.listStatus(folder))
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]

    def _read(self, spark: SparkSession, number: int) -> dict:
        _, files = self._folder(spark)
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number:08d}.json")
        stream = files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
