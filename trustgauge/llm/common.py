"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as estimated by rows * width, that is ever broadcast.
BROADCAST_BYTES = 16 << 20

#: White space between words, as a Java / RE2 class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows of an Arrow batch at most: texts may be long, and a worker holds several copies of a batch.
BATCH_ROWS = 2000


def tidy() -> None:
    """Give freed memory back before a Python worker idles: the JVM beside it may need it for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidied(run):
    """A function over batches that tidies up at its end."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive lost executors.

    Results are lazy, so the tables stay until the session ends, or until ``settle`` has written what needs them.
    """

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        self.spark, self.top, self.names = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", set()
        Scratch.live.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table; the others go, so nothing that is returned may read them."""
        out = self.keep(df, name)
        self.drop(*self.names - {name})
        return out

    def clear(self) -> None:
        if self.spark._sc._jsc is not None:  # a stopped session can't
            with contextlib.suppress(Exception):
                self.drop("")
        if self in Scratch.live:
            Scratch.live.remove(self)

    def settle(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """What ``make`` returns as a table of its own; all tables that were written for it go."""
        before = len(Scratch.live)
        out = self.keep(make(), name)
        for other in Scratch.live[before:]:
            other.clear()
        return out


@atexit.register
def _clear_all() -> None:
    for scratch in list(Scratch.live):
        scratch.clear()


def join_sized(left: DataFrame, right: DataFrame, on, how: str, width: int) -> DataFrame:
    """Join to a written table: broadcast it if its rows * width are within the bound, else shuffle."""
    if right.count() * width <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def most_frequent(counted: DataFrame, key: str, most: int) -> list[int]:
    """Keys of a table (key, n) with the largest counts, ``most`` at most; those that share the count where the line falls all stay out.

    The line comes from a histogram of the counts, a row for each eighth of a doubling, so no task sorts the keys.
    """
    step = F.floor(F.log2("n") * 8)
    hist = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("keys")).collect()
    line, total = None, 0
    for r in sorted(hist, key=lambda r: -r["step"]):
        total += r["keys"]
        if total > most:
            break
        line = r["step"]
    return [] if line is None else counted.where(step >= line).select(key).toPandas()[key].tolist()


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Characters of keys that a bounded map holds at most, whatever their number; twice as many at most.
KEPT_CHARACTERS = 16 << 20
#: Keys longer than this are not remembered.
LONGEST_KEY = 1000


class Recent:
    """A bounded map: beyond its size, in entries or characters of keys, the entries not used of late go."""

    def __init__(self, most: int):
        self.most, self.now, self.before, self.size = most, {}, {}, 0

    def add(self, new: dict) -> None:
        for k, v in new.items():
            if len(k) <= LONGEST_KEY:
                self.now[k] = v
                self.size += len(k)

    def find(self, keys: list) -> list:
        """Values of keys, None where there is none."""
        if len(self.now) > self.most or self.size > KEPT_CHARACTERS:
            self.size = 0
            self.now, self.before = {}, self.now
        out = list(map(self.now.get, keys))
        if self.before and None in out:
            now, before = self.now, self.before
            for i, v in enumerate(out):
                if v is None and (v := before.get(keys[i])) is not None:
                    out[i] = now[keys[i]] = v
        return out


#: Texts of a batch are handled in parts of about so many characters.
PART = 2_000_000


def parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > PART:
            yield part
            part, size = [], 0
    if part:
        yield part
