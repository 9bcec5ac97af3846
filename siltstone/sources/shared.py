"""Folders that every executor can reach."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from siltstone.errors import Corrupted, StorageError


#: Bytes of a table that fill one split.
SPLIT_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine, as in tests, a fresh
    temporary folder is set as checkpoint folder once for the context and removed
    when Python ends. On a cluster a folder of one machine would be no use: there the
    setting is required.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    known = getattr(spark.sparkContext, "_siltstone_shared", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("spark.checkpoint.dir must name a folder that all executors reach")
        known = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(known)
        spark.sparkContext._siltstone_shared = known
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all frames, matched by column name.

    Spark 4.1 takes a union of equally partitioned inputs for partitioned alike and
    may then reuse one exchange for several of them, after which it no longer is:
    groups come out in parts. The session is told not to rely on it.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other)
    return first


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_listings(spark: SparkSession) -> None:
    """Let folders of thousands of files be listed by some tasks a core, not by one a file."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.set(name, min(int(spark.conf.get(name)), 4 * spark.sparkContext.defaultParallelism))


def file_versions(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, bytes and time of change of each file that a frame reads."""
    out = []
    for path in sorted(df.inputFiles()):
        jvm, fs = _fs(df.sparkSession, path)
        status = fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(path))
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def spread(df: DataFrame) -> DataFrame:
    """A file scan with at least one task per core.

    Where a table's few files make fewer splits than the session has cores, its rows
    are dealt out once, for work that costs more than that shuffle. This is a matter of
    layout alone, for small tables; one with enough files or bytes is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    size = sum(n for _, n, _ in file_versions(df))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; empty where the folder does not exist."""
    jvm, fs = _fs(spark, path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    jvm, fs = _fs(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    jvm, fs = _fs(spark, path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    except Py4JJavaError as e:
        raise Corrupted(f"{path} cannot be read") from e
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file next to ``path`` and rename it over ``path``."""
    jvm, fs = _fs(spark, path)
    Path = jvm.org.apache.hadoop.fs.Path
    part = Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    overwrite = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(
        getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1
    )
    options[0] = overwrite
    context.rename(part, Path(path), options)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if another writer made it first.

    The text is written aside and given its name in one step that fails where the name
    is taken: by a hard link on a local file system, else by a rename without overwriting.
    """
    jvm, fs = _fs(spark, path)
    Path = jvm.org.apache.hadoop.fs.Path
    target = fs.makeQualified(Path(path))
    part = Path(f"{target.toString()}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    try:
        if target.toUri().getScheme() == "file":
            local = [jvm.java.nio.file.Path.of(jvm.java.net.URI.create(f"file://{p.toUri().getPath()}")) for p in (target, part)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
            )
            none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(part, target, none)
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(part, False)
    return True


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was last changed."""
    jvm, fs = _fs(spark, path)
    changed = fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(path)).getModificationTime()
    return (jvm.java.lang.System.currentTimeMillis() - changed) / 1000


class PublishedTable:
    """A table whose whole content changes at once.

    Every publication is written to a generation folder of its own by Spark's commit
    protocol; then a numbered note that names the folder is created. The note with the
    highest number is in force, and as a number can be taken only once, one of two
    writers that began from the same state fails. ``retained`` generations before the
    current one stay, for readers and lazy frames that began earlier.
    """

    _NOTE = re.compile(r"note-(\d{20})\.json")

    def __init__(self, spark: SparkSession, path: str, retained: int = 4):
        self.spark, self.path, self.retained = spark, path.rstrip("/"), retained

    def _numbers(self) -> list[int]:
        found = (self._NOTE.fullmatch(name) for name in list_dir(self.spark, self.path))
        return sorted(int(m.group(1)) for m in found if m)

    def current(self) -> dict | None:
        """What the last publication noted, its generation among it; None before the first."""
        numbers = self._numbers()
        text = read_text(self.spark, f"{self.path}/note-{numbers[-1]:020d}.json") if numbers else None
        return json.loads(text) if text else None

    def read(self) -> DataFrame:
        now = self.current()
        if now is None:
            raise StorageError(f"nothing has been published under {self.path}")
        return self.spark.read.parquet(f"{self.path}/{now['generation']}")

    def publish(self, df: DataFrame, expected: str | None = None, **notes) -> DataFrame:
        """Write ``df`` as the next generation and make it current.

        The publication fails if another one came in between; with ``expected`` also
        unless that generation is current.
        """
        now = self.current()
        if expected is not None and (now or {}).get("generation") != expected:
            raise StorageError("the table changed since it was read")
        number = int(now["generation"].split("-")[1]) + 1 if now else 1
        name = f"generation-{number:020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        if not create_text(self.spark, f"{self.path}/note-{number:020d}.json", json.dumps({"generation": name} | notes)):
            remove(self.spark, f"{self.path}/{name}")
            raise StorageError("the table was published by someone else meanwhile")
        for old in self._numbers():
            if old < number - self.retained:
                text = read_text(self.spark, f"{self.path}/note-{old:020d}.json")
                if text:
                    remove(self.spark, f"{self.path}/{json.loads(text)['generation']}")
                remove(self.spark, f"{self.path}/note-{old:020d}.json")
        return self.spark.read.parquet(f"{self.path}/{name}")


def scratch_table(spark: SparkSession, name: str) -> PublishedTable:
    """A table of this application in the shared folder."""
    app = spark.sparkContext.applicationId
    return PublishedTable(spark, f"{shared_dir(spark)}/siltstone/{app}/{name}")
