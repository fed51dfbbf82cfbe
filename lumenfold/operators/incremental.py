"""Processing only new or changed records.

The operator keeps a *state*: one row per key with the hashes of the record as last processed. A run hashes the current rows,
joins them with the state in force and gets `add`, `change` and `delete`; after the run has succeeded, its rows are written as
a new version and put in force by one atomic step. A run that dies before that leaves the old version in force, so its records
come again; a record of a finished run doesn't.

Two hashes make up a fingerprint: of the content, null where the content hash isn't known, and of size and mtime. A record has
changed if the content hashes differ or, where one is null, the others do.

Defined results: rows with a null key are ignored; a null `seen_at` is older than any other; exact redeliveries count
once; a null status counts as neither error nor deleted; an empty log gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import apart, scratch

STATE_COLUMNS = ("content_hash", "size", "mtime", "status")


def _record(columns: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def latest(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seen_at", "loaded_at"), columns: tuple[str, ...] = STATE_COLUMNS) -> DataFrame:
    """One row per key: the record with the greatest order. A hot key is reduced before the shuffle."""
    rank = F.struct(*[F.col(c) for c in order], _record(columns).alias("_tie"))
    return (
        log.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(rank)["_tie"].alias("rec"))
        .select("_key", "rec.*")
    )


def committed(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose last_indexed_at lies in a successful run, both ends included, and whose status isn't error.

    The interval join is made an equi-join on the day: a run covers few days, so each run becomes a row per day."""
    ok = (
        runs.where((F.col("outcome") == "success") & (F.col("finished_at") >= F.col("started_at")))
        .select("started_at", "finished_at")
        .distinct()
        .withColumn("_day", F.explode(F.sequence(F.to_date("started_at"), F.to_date("finished_at"))))
    )
    rows = log.where(F.coalesce(F.col("status"), F.lit("")) != "error").withColumn("_at", F.to_date("last_indexed_at"))
    return rows.join(
        ok,
        (rows["_at"] == ok["_day"]) & (rows["last_indexed_at"] >= ok["started_at"]) & (rows["last_indexed_at"] <= ok["finished_at"]),
        "left_semi",
    ).drop("_at")


def fingerprints(records: DataFrame) -> DataFrame:
    """_key, content, stat (hashes), gone: of rows _key with STATE_COLUMNS, one per key."""
    of = lambda *c: F.sha2(F.to_json(F.struct(*c), {"ignoreNullFields": "false"}), 256)
    return records.select(
        "_key",
        F.when(F.col("content_hash").isNotNull(), of("content_hash")).alias("content"),
        of("size", F.unix_micros("mtime").alias("mtime")).alias("stat"),
        F.col("status").eqNullSafe(F.lit("deleted")).alias("gone"),
    )


def diff(current: DataFrame, state: DataFrame) -> DataFrame:
    """current and state: fingerprints, one row per _key. Result: _key, action (add, change or delete)."""
    c, b = apart(current).alias("c"), apart(state.where("NOT gone")).alias("b")
    joined = c.join(b, F.col("c._key") == F.col("b._key"), "left")
    has_base = F.col("b._key").isNotNull()
    unknown = F.col("c.content").isNull() | F.col("b.content").isNull()
    changed = F.when(unknown, F.col("c.stat") != F.col("b.stat")).otherwise(F.col("c.content") != F.col("b.content"))
    action = F.when(F.col("c.gone") & has_base, "delete").when(~F.col("c.gone") & ~has_base, "add").when(~F.col("c.gone") & has_base & changed, "change")
    return joined.select(F.col("c._key").alias("_key"), action.alias("action")).where(F.col("action").isNotNull())


def pending(files: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """The files the next run must process: file_id, action. The state of what the successful runs committed is taken from the
    log, put in force below `root` (a new folder of the application if none is given), and the current rows are compared with it."""
    spark = files.sparkSession
    state = VersionedState(spark, root or scratch(spark, "index-state"))
    state.swap(fingerprints(latest(committed(files, runs))))
    return state.pending(fingerprints(latest(files))).select(F.col("_key").alias("file_id"), "action")


class VersionedState:
    """State of an incremental job below `root` in the shared folder: version folders and numbered pointer files.

    A version is written to a folder of its own name, then `swap` brings a pointer file with that name to its number in one
    step that fails if the number is taken. So a reader sees the old or the new version whole, and of two runs that started
    from the same version one wins and the other gets an error; neither touches the other's rows. Folders that no pointer names
    are leftovers of failed runs. The step is a rename that refuses an existing target (HDFS), or a hard link on a mounted file
    system (local, NFS); stores with neither aren't supported."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def version(self) -> int:
        """The version in force; 0 before the first."""
        names = (st.getPath().getName() for st in self._fs.listStatus(self._path(self.root)))
        return max((int(n[len("current-") :]) for n in names if n.startswith("current-")), default=0)

    def folder(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/current-{version}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/{self.folder(v)}") if v else None

    def pending(self, current: DataFrame) -> DataFrame:
        """Actions for `current` (fingerprints, one row per _key) against the version in force."""
        state = self.read()
        return diff(current, current.where(F.lit(False)) if state is None else state)

    def swap(self, current: DataFrame, after: int | None = None) -> int:
        """Put `current` in force as the next version, to be called when the run's work is done. after: the version the run
        started from (the one in force now if not given); fails if another run has put a version in force since."""
        v = (self.version() if after is None else after) + 1
        name = f"v{v}-{uuid.uuid4().hex}"
        current.write.parquet(f"{self.root}/{name}")
        self.point(v, name)
        return v

    def point(self, v: int, name: str) -> None:
        ready, target = self._path(f"{self.root}/_pointer-{name}"), self._path(f"{self.root}/current-{v}")
        out = self._fs.create(ready, True)
        out.write(bytearray(name.encode()))
        out.close()
        taken = RuntimeError(f"version {v} of {self.root} was put in force by another run")
        if self._fs.getUri().getScheme() == "file":
            files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
            at = lambda p: paths.get(self._fs.makeQualified(p).toUri())
            try:
                files.createLink(at(target), at(ready))
            except Py4JJavaError as e:
                raise taken from e
            finally:
                self._fs.delete(ready, False)
        elif not self._fs.rename(ready, target):
            raise taken
