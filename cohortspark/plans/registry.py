"""Stage tables addressed by what they were made from.

A stage's address is a digest of its input files (path, size, time), of the stages it reads, of the
parameters and of its plan with the running numbers taken out. A stage that is there is read, whoever
made it; else it is written to a folder of its own, and a marker that names this folder is written
last. A run that dies leaves a folder without marker, which nobody reads; of two runs that write the same
stage, the first marker counts. All files lie under the shared folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import checkpoint_dir

#: session setting that places the registry elsewhere (a shared folder)
ROOT_SETTING = "cohortspark.stages.root"
#: bytes of a row group of a stage table: a file is read by as many tasks as it has row groups, so that the work on a
#: stage is dealt over the cluster however few files or row groups its input had
ROW_GROUP = 8 << 20
#: digest and schema of the plans that this process has built
_PLANS: dict[str, tuple] = {}


class Staged(NamedTuple):
    df: DataFrame
    digest: str


def files_digest(spark: SparkSession, paths: Iterable[str]) -> str:
    """Digest of the files below ``paths``: their number, sizes and times. A folder is listed by a Spark
    job that reads no file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = []
    for path in sorted(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(conf).getFileStatus(p)
        if status.isDirectory():
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
            parts.append(f"{path} {tuple(row)}")
        else:
            parts.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def plan_digest(df: DataFrame) -> str:
    """Digest of the analysed plan; expression and lambda numbers count in the order of their appearance."""
    spark = df.sparkSession
    setting = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(2**31 - 1))
    try:
        text = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(setting, before)
    seen: dict[str, str] = {}
    plain = re.sub(r"#\d+L?|\b[a-z]+_\d+\b", lambda m: seen.setdefault(m[0], f"#{len(seen)}"), text)
    return hashlib.sha256(plain.encode()).hexdigest()


class Registry:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get(ROOT_SETTING, None) or f"{checkpoint_dir(spark).rstrip('/')}/stages").rstrip("/")

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _marked(self, place: str) -> str | None:
        """The folder that the marker of ``place`` names."""
        fs, p = self._file(f"{place}/CURRENT")
        if not fs.exists(p):
            return None
        row = self.spark.read.text(f"{place}/CURRENT").first()
        return f"{place}/{row[0]}" if row else None

    def _mark(self, place: str, folder: str) -> None:
        fs, p = self._file(f"{place}/.{folder}.tmp")
        out = fs.create(p, True)
        out.write(bytearray(folder.encode()))
        out.close()
        _, goal = self._file(f"{place}/CURRENT")
        fs.rename(p, goal)  # does not replace a marker that is there

    def address(self, name: str, build: Callable[[], DataFrame], files: Iterable[str], parents: Iterable[Staged] = (), params: object = None,
                schema: list | None = None) -> str:
        """The digest of a stage. The plan is built once a session for each name, files, parents and
        parameters."""
        known = "\n".join([name, *files, *(p.digest for p in parents), repr(params)])
        if known not in _PLANS:
            df = build()
            _PLANS[known] = plan_digest(df), df.schema
        text = "\n".join([known, files_digest(self.spark, files), _PLANS[known][0]])
        if schema is not None:
            schema.append(_PLANS[known][1])
        return hashlib.sha256(text.encode()).hexdigest()[:32]

    def made(self, name: str, digest: str, make: Callable[[str], None]) -> str:
        """The folder of what ``make(folder)`` writes, made if it is not there."""
        place = f"{self.root}/{name}-{digest}"
        found = self._marked(place)
        if found is None:
            folder = uuid.uuid4().hex
            make(f"{place}/{folder}")
            self._mark(place, folder)
            found = self._marked(place)
        return found

    def stage(self, name: str, build: Callable[[], DataFrame], files: Iterable[str], parents: Iterable[Staged] = (), params: object = None) -> Staged:
        """The table that ``build()`` describes. ``params`` has to name whatever else ``build`` depends on."""
        schema: list = []
        digest = self.address(name, build, files, parents, params, schema)
        path = self.made(name, digest, lambda folder: build().write.option("parquet.block.size", ROW_GROUP).parquet(folder))
        return Staged(self.spark.read.schema(schema[0]).parquet(path), digest)
