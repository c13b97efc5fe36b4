"""Small files of stored tables, through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


class ArchiveError(ValueError):
    pass


class Store:
    """Hadoop file-system calls that the manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str:
        if not self.fs.exists(self.path(name)):
            raise ArchiveError(f"no {name} in {self.root}")
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect())

    def replace(self, name: str, text: str) -> None:
        """Write beside, then rename over: readers see the old or the new file."""
        tmp = self.path(f".{name}.new")
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else self.fs.getUri(), conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        opts = self.spark.sparkContext._gateway.new_array(option, 1)
        opts[0] = option.OVERWRITE
        context.rename(self.fs.makeQualified(tmp), self.fs.makeQualified(self.path(name)), opts)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path())] if self.fs.exists(self.path()) else []

    def size(self, name: str) -> tuple[int, int]:
        """(bytes, files) below a name."""
        if not self.fs.exists(self.path(name)):
            return 0, 0
        s = self.fs.getContentSummary(self.path(name))
        return s.getLength(), s.getFileCount()
