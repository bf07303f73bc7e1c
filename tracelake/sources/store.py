"""Telemetry tables as Parquet by UTC day: writing, promotion, retention, compaction, export and figures.

A table is a folder of day partitions.  A day is written by as many tasks as
its hours need; files keep their rows sorted by time, so statistics prune row
groups; ids of spans have bloom filters.  Promoted attributes are string
columns named after their keys, filled from the JSON; files from before a
promotion read them as null and queries fall back.

Readers take a list of files (``files``), which a ``Snapshot`` pins.  Compaction
adds files named after its run, which no reader takes until the run's one small
list of replaced files is renamed into place; from then on they stand for the
old ones.  That rename is the only switch, so a crash before or after it loses
and doubles nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import floor_div, json_get_str
from . import schema as S

_DAY, _HOUR = 86_400_000_000_000, 3_600_000_000_000


@dataclass(frozen=True)
class Snapshot:
    """The files of every table at one moment; later writes and compactions do not show in it."""

    store: Store
    listing: dict[str, tuple[str, ...]]

    def read(self, table: str) -> DataFrame:
        return self.store.read(table, list(self.listing[table]))


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    compression: str = "zstd"

    # files of the store, through Hadoop's file systems, so that any store Spark reads will do
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _rename(self, a: str, b: str) -> None:
        fs, at = self._fs(a)
        fs.rename(at, self._fs(b)[1])

    def _mkdirs(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.mkdirs(at)

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _glob(self, pattern: str) -> bool:
        """Whether any path fits; one call, however many days there are."""
        fs, at = self._fs(pattern)
        return bool(fs.globStatus(at))

    def _size(self, path: str) -> int:
        fs, at = self._fs(path)
        return fs.getFileStatus(at).getLen()

    def _text(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, at = self._fs(path)
        stream = fs.create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _days(self, table: str) -> list[int]:
        return sorted(int(n.removeprefix("day=")) for n in self._names(f"{self.path}/{table}") if n.startswith("day="))

    def promoted(self) -> list[str]:
        at = f"{self.path}/promoted"
        return [r["key"] for r in self.spark.read.json(at).orderBy("place").collect()] if self._exists(at) else []

    def set_promoted(self, keys: list[str]) -> None:
        """Keys from now on; files that are there are filled when they are compacted."""
        rows = [json.dumps({"place": i, "key": k}) for i, k in enumerate(S.promoted(keys))]
        self.spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/promoted")

    def _filled(self, df: DataFrame, table: str) -> DataFrame:
        keys = self.promoted()
        out = S.coerce(df, table, keys)
        return out.withColumns({k: F.coalesce(F.col(f"`{k}`"), json_get_str(F.col("attributes"), k)) for k in keys}) if keys else out

    def _write(self, df: DataFrame, table: str, path: str, mode: str = "append") -> None:
        ns = F.col(S.time_column(table))
        days = df.withColumn("day", floor_div(ns, _DAY).cast("int"))
        out = days.repartition("day", floor_div(ns, _HOUR)).sortWithinPartitions("day", S.time_column(table)).write.mode(mode).partitionBy("day").option("compression", self.compression)
        if table == "spans":
            out = out.option("parquet.bloom.filter.enabled#trace_id", "true").option("parquet.bloom.filter.enabled#span_id", "true")
        out.parquet(path)

    def append(self, df: DataFrame, table: str) -> None:
        self._write(self._filled(df, table), table, f"{self.path}/{table}")

    def append_once(self, df: DataFrame, table: str, token: str) -> None:
        """Append under a token: what an earlier try of the same token left is replaced, and a finished one is not repeated."""
        done, staged = f"{self.path}/.batches/{token}/{table}", f"{self.path}/.staging/{token}-{table}"
        if self._exists(done):
            return
        for day in self._days(table):
            for name in self._names(f"{self.path}/{table}/day={day}"):
                if name.startswith(f"b-{token}-"):
                    self._delete(f"{self.path}/{table}/day={day}/{name}")
        self._write(self._filled(df, table), table, staged, "overwrite")
        for folder in self._names(staged):
            if folder.startswith("day="):
                self._mkdirs(f"{self.path}/{table}/{folder}")
                for i, name in enumerate(n for n in self._names(f"{staged}/{folder}") if n.endswith(".parquet")):
                    self._rename(f"{staged}/{folder}/{name}", f"{self.path}/{table}/{folder}/b-{token}-{i}.parquet")
        self._mkdirs(done)
        self._delete(staged)

    def _listed(self, folder: str) -> list[str]:
        """The names of the data files of a day that a reader takes."""
        names = self._names(folder)
        runs = {n.removeprefix("_run-").removesuffix(".json") for n in names if n.startswith("_run-") and n.endswith(".json")}
        replaced = {x for r in runs for x in json.loads(self._text(f"{folder}/_run-{r}.json"))}
        data = [n for n in names if n.endswith(".parquet") and not n.startswith(("_", "."))]
        return [n for n in data if n not in replaced and (not n.startswith("c-") or n.split("-")[1] in runs)]

    def files(self, table: str) -> list[str]:
        root = f"{self.path}/{table}"
        return [f"{root}/day={d}/{n}" for d in self._days(table) for n in self._listed(f"{root}/day={d}")]

    def snapshot_files(self) -> Snapshot:
        """A reader's view that stays as it is."""
        return Snapshot(self, {t: tuple(self.files(t)) for t in S.TABLES})

    def read(self, table: str, files: list[str] | None = None) -> DataFrame:
        """The table with its promoted columns; days prune partitions and the time column prunes row groups."""
        root = f"{self.path}/{table}"
        # the schema is known, so no footer is read to find it; files from before a promotion lack its columns
        reader = self.spark.read.schema(StructType([*S.schema(table).fields, *[StructField(k, StringType()) for k in self.promoted()]]))
        if files is None and not self._glob(f"{root}/day=*/_run-*") and not self._glob(f"{root}/day=*/c-*"):
            if not self._days(table):
                return self.spark.createDataFrame([], S.schema(table))
            rows = reader.parquet(root)  # no compaction: every file counts
            return S.coerce(rows, table, self.promoted())
        files = self.files(table) if files is None else files
        if not files:
            return self.spark.createDataFrame([], S.schema(table))
        rows = reader.option("basePath", root).parquet(*files)
        return S.coerce(rows, table, self.promoted())

    def register(self) -> None:
        """Every table as a temporary view, for spark.sql."""
        for t in S.TABLES:
            self.read(t).createOrReplaceTempView(t)

    def export(self, table: str, start: int | None = None, end: int | None = None) -> pa.RecordBatchReader:
        """Rows of a time range in time order, as Arrow batches; an hour at a time is on the driver."""
        rows, ns = self.read(table), S.time_column(table)
        inside = lambda a, b: rows.where((F.col(ns) >= F.lit(a).cast("long")) & (F.col(ns) < F.lit(b).cast("long")))
        low, high = rows.agg(F.min(ns), F.max(ns)).first()
        first = rows.limit(0).toArrow()

        def batches() -> Iterator[pa.RecordBatch]:
            if low is None:
                return
            a, z = max(low, low if start is None else start), min(high + 1, high + 1 if end is None else end)
            hours = [r.h for r in inside(a, z).select(floor_div(F.col(ns), _HOUR).alias("h")).distinct().orderBy("h").toLocalIterator()] if a < z else []
            for h in hours:
                yield from inside(max(a, h * _HOUR), min(z, (h + 1) * _HOUR)).orderBy(ns).toArrow().cast(first.schema).to_batches()

        return pa.RecordBatchReader.from_batches(first.schema, batches())

    def stats(self) -> DataFrame:
        """Rows, files and time span of each table."""
        out = None
        for t in S.TABLES:
            ns = S.time_column(t)
            one = self.read(t).agg(F.count("*").alias("rows"), F.min(ns).alias("first_ns"), F.max(ns).alias("last_ns")).select(F.lit(t).alias("table"), "rows", F.lit(len(self.files(t))).alias("files"), "first_ns", "last_ns")
            out = one if out is None else out.unionByName(one)
        return out

    def retain(self, oldest_ns: int | None = None, most_bytes: int | None = None) -> int:
        """Drop days that end before oldest_ns, then the oldest days until the tables fit; how many were dropped."""
        days = sorted((d, t) for t in S.TABLES for d in self._days(t))
        gone = [(d, t) for d, t in days if oldest_ns is not None and (d + 1) * _DAY <= oldest_ns]
        kept = [x for x in days if x not in set(gone)]
        if most_bytes is not None:
            size = {}
            for d, t in kept:
                fs, at = self._fs(f"{self.path}/{t}/day={d}")
                size[d, t] = fs.getContentSummary(at).getLength()
            total = sum(size.values())
            for x in kept:
                if total <= most_bytes:
                    break
                total -= size[x]
                gone.append(x)
        for d, t in gone:
            self._delete(f"{self.path}/{t}/day={d}")
        return len(gone)

    def compact(self, most_partitions: int | None = None, file_bytes: int = 512 << 20) -> int:
        """Rewrite days of several small files, or that lack a promoted column, as sorted files of about file_bytes; how many were rewritten."""
        done = 0
        for t in S.TABLES:
            wanted = {n for n, _ in S.columns(t)} | set(self.promoted())
            for d in self._days(t):
                if most_partitions is not None and done >= most_partitions:
                    return done
                at = f"{self.path}/{t}/day={d}"
                self._sweep(at)
                names = self._listed(at)
                size = sum(self._size(f"{at}/{n}") for n in names)
                files = max(1, -(-size // file_bytes))
                if not names or len(names) <= files and set(self.spark.read.option("mergeSchema", "true").parquet(*[f"{at}/{n}" for n in names]).columns) == wanted:
                    continue
                run, new = uuid.uuid4().hex, f"{self.path}/.compact/{t}-{d}"
                rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{at}/{n}" for n in names])
                ns = S.time_column(t)
                out = self._filled(rows, t)
                out = out.coalesce(1) if files == 1 else out.repartitionByRange(files, ns)
                write = out.sortWithinPartitions(ns).write.mode("overwrite").option("compression", self.compression)
                if t == "spans":
                    write = write.option("parquet.bloom.filter.enabled#trace_id", "true").option("parquet.bloom.filter.enabled#span_id", "true")
                write.parquet(new)
                for i, n in enumerate(x for x in self._names(new) if x.endswith(".parquet")):
                    self._rename(f"{new}/{n}", f"{at}/c-{run}-{i}.parquet")
                self._put(f"{at}/_new-{run}.json", json.dumps(names))
                self._rename(f"{at}/_new-{run}.json", f"{at}/_run-{run}.json")  # the switch
                self._delete(new)
                done += 1
        return done

    def _sweep(self, folder: str) -> None:
        """Delete files that no reader takes: replaced ones, and what a run left that never switched.  A list of
        replaced files stays as long as files of its run do."""
        taken, names = set(self._listed(folder)), self._names(folder)
        for n in names:
            if n.endswith(".parquet") and n not in taken or n.startswith("_new-"):
                self._delete(f"{folder}/{n}")
        for n in names:
            if n.startswith("_run-") and not any(x.startswith(f"c-{n[5:-5]}-") for x in taken):
                self._delete(f"{folder}/{n}")

    def snapshot(self, path: str) -> Store:
        """A copy of the store as it is now."""
        jvm = self.spark.sparkContext._jvm
        fs, at = self._fs(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        other, to = self._fs(path)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, other, to, False, conf)
        return Store(self.spark, path, self.compression)
