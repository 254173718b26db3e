"""Folders of a table that grows by batches, on shared storage.

A batch is a folder whose last part to be written, ``seal``, makes it visible: readers never see half a
batch, and a batch that failed is written again over its remains. A full generation stands for all before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Generations:
    spark: SparkSession
    path: str
    seal: str

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path_of = jvm.org.apache.hadoop.fs.Path
        return path_of(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path_of

    def folder(self, number: int, full: bool = False) -> str:
        return f"{self.path}/{'full' if full else 'part'}-{number:08d}"

    @staticmethod
    def number(name: str) -> int:
        return int(name.split("-")[1])

    def names(self) -> list[str]:
        """Visible folders, oldest first, from the newest full one on."""
        fs, path_of = self._files()
        if not fs.exists(path_of(self.path)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path_of(self.path))]
        done = sorted((n for n in found if fs.exists(path_of(f"{self.path}/{n}/{self.seal}/_SUCCESS"))), key=lambda n: (self.number(n), n < "full"))
        full = [n for n in done if n.startswith("full-")]
        return done[done.index(full[-1]) :] if full else done

    def drop(self, names: list[str]) -> None:
        fs, path_of = self._files()
        for name in names:
            fs.delete(path_of(f"{self.path}/{name}"), True)
