"""Control files in any file system that Spark reaches: pointers, locks and folders by Hadoop's API."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":  # without checksum files: what is tampered with is found by its digest
        fs = jvm.org.apache.hadoop.fs.RawLocalFileSystem()
        fs.initialize(jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark names files."""
    fs, p = _of(spark, path)
    return fs.makeQualified(p).toString()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none."""
    fs, p = _of(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    fs, p = _of(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(temp, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
            out.hsync()
        finally:
            out.close()
        if fs.getUri().getScheme() == "file":  # a rename that replaces
            fs.rename(temp, p)
            return
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(temp), fs.makeQualified(p), how)
    finally:
        fs.delete(temp, False)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that nobody has created yet; false if somebody has."""
    fs, p = _of(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
            return False
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    fs, p = _of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Lease:
    """A lock that outlives no dead holder: a folder of claims, each a file with a fencing number.

    The claim with the greatest number holds the lock until it is released or its heartbeat is
    older than ``seconds``. Taking the lock means creating the next number, which the file system grants
    to one taker only. A holder that was taken over sees a greater number than its own and must stop;
    ``number`` goes into what it writes, so that readers can order writers. Clocks of holders may
    differ by less than ``seconds``.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 600.0):
        self.spark, self.folder, self.seconds = spark, folder, seconds
        self.owner, self.number = uuid.uuid4().hex, 0

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def _latest(self) -> int:
        return max((int(n[:-5]) for n in names(self.spark, self.folder) if n.endswith(".json") and not n.startswith(".")), default=0)

    def _state(self, released: bool) -> str:
        return json.dumps({"owner": self.owner, "heartbeat": time.time(), "released": released})

    def take(self) -> bool:
        """Whether the lock is ours now."""
        last = self._latest()
        if last:
            text = read_text(self.spark, self._path(last))
            try:
                state = json.loads(text or "")
            except ValueError:  # its taker is writing, or died as it wrote
                state = {"released": False, "heartbeat": modified(self.spark, self._path(last))}
            if not state["released"] and time.time() - state["heartbeat"] < self.seconds:
                return False
        if not created(self.spark, self._path(last + 1), self._state(False)):
            return False
        self.number = last + 1
        for old in range(max(1, last - 8), last):  # the last claim before ours stays, for who reads it now
            delete(self.spark, self._path(old))
        return True

    def held(self) -> bool:
        return self.number > 0 and self._latest() == self.number

    def beat(self) -> None:
        """Say that the holder lives; an error if the lock was taken over."""
        if not self.held():
            raise ValueError("PUBLISH_FENCED")
        write_text(self.spark, self._path(self.number), self._state(False))

    def release(self) -> None:
        if self.held():
            write_text(self.spark, self._path(self.number), self._state(True))


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 at which a file was last written."""
    fs, p = _of(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _of(spark, path)
    fs.delete(p, True)
