"""Several tables that change together: one manifest names the files of all of them, so a reader sees all of a change or nothing.

A change writes, for each table that it touches, rows that replace those of their keys and keys that go (tombstones), dealt into
buckets by key. Then the next manifest is put in place by one rename that fails if that version is there already. Reading merges:
the latest row of a key counts. Only the changes are compared with each other; the base of a table, its largest part, loses the
keys that they have by one anti-join. ``compact`` makes a new base of a table; ``vacuum`` removes files that no kept version names.

Null keys are keys, and in the columns that a table ``folds`` null and the empty text are the same key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    schema: str
    keys: tuple[str, ...]
    folds: tuple[str, ...] = ()
    buckets: int = 16


@dataclass
class Change:
    """What happens to one table. ``gone`` has at least the key columns; a key that is in both is put."""

    put: DataFrame | None = None
    gone: DataFrame | None = None


@dataclass
class Store:
    spark: SparkSession
    base: str
    tables: dict[str, Table]
    _jvm: object = field(default=None, repr=False)

    # manifests

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 for an empty store."""
        fs, place = self._files(), self._path("manifests")
        if not fs.exists(place):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """For each table its parts in order, the base first."""
        version = self.version() if version is None else version
        if version == 0:
            return {name: [] for name in self.tables}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.base}/manifests/{version}.json").collect()))

    def _publish(self, number: int, parts: dict[str, list[str]]) -> None:
        fs, hidden = self._files(), self._path("manifests", f".{uuid.uuid4().hex}")
        fs.mkdirs(self._path("manifests"))
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri() if hidden.isAbsolute() and hidden.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(hidden, self._path("manifests", f"{number}.json"), options)
        except Exception as error:
            fs.delete(hidden, False)
            raise RuntimeError(f"version {number} was published by another writer") from error

    # rows

    def _folded(self, table: Table) -> list[Column]:
        return [(F.coalesce(k, F.lit("")) if k in table.folds else F.col(k)).alias(f"_k{i}") for i, k in enumerate(table.keys)]

    def _same(self, table: Table) -> Column:
        return reduce(lambda a, b: a & b, (F.col(f"_k{i}").eqNullSafe(F.col(f"_o{i}")) for i in range(len(table.keys))))

    def _write(self, name: str, change: Change) -> str:
        table, path = self.tables[name], f"data/{name}/{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], table.schema)
        put = (change.put if change.put is not None else empty).select(*empty.columns)
        put = put.select(*(F.col(f.name).cast(f.dataType) for f in empty.schema), F.lit(False).alias("_gone"))
        rows = put
        if change.gone is not None:
            kinds = {f.name: f.dataType for f in empty.schema}
            gone = change.gone.select(*(F.col(c).cast(kinds[c]) if c in table.keys else F.lit(None).cast(kinds[c]).alias(c) for c in empty.columns), F.lit(True).alias("_gone"))
            rows = put.unionByName(gone)
        rows = rows.select("*", *self._folded(table))
        keys = [f"_k{i}" for i in range(len(table.keys))]
        # one row for each key: one that is put before one that goes
        columns = [*empty.columns, "_gone"]
        one = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("_gone", F.xxhash64(*(c for c in empty.columns)))).alias("row"))
        bucket = F.pmod(F.xxhash64(*keys), F.lit(table.buckets)).cast("int").alias("_bucket")
        one.select(bucket, "row.*").repartition(table.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.base}/{path}")
        return path

    def _part(self, name: str, path: str, number: int) -> DataFrame:
        table = self.tables[name]
        columns = self.spark.createDataFrame([], table.schema).schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", _gone boolean, _bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.base}/{path}").select("*", F.lit(number).alias("_n"), *self._folded(table))

    def read(self, name: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows of a table. ``only``: a few keys; then the buckets that can't hold them are not read."""
        table, paths = self.tables[name], self.manifest(version)[name]
        columns = self.spark.createDataFrame([], table.schema).columns
        if not paths:
            return self.spark.createDataFrame([], table.schema)
        parts = [self._part(name, p, n) for n, p in enumerate(paths)]
        if only is not None:
            asked = only.select(*self._folded(table)).distinct()
            bucket = F.pmod(F.xxhash64(*(f"_k{i}" for i in range(len(table.keys)))), F.lit(table.buckets)).cast("int")
            held = [r.b for r in asked.select(bucket.alias("b")).distinct().collect()]  # at most one for each bucket
            wanted = asked.toDF(*(f"_o{i}" for i in range(len(table.keys))))
            parts = [p.filter(F.col("_bucket").isin(*held)).join(wanted, self._same(table), "left_semi") for p in parts]
        base = parts[0].filter("NOT _gone")
        if len(parts) == 1:
            return base.select(*columns)
        changes = reduce(DataFrame.unionByName, parts[1:])
        keys = [f"_k{i}" for i in range(len(table.keys))]
        latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns, "_gone"), "_n").alias("row"))
        touched = latest.select(*(F.col(f"_k{i}").alias(f"_o{i}") for i in range(len(table.keys))))
        return base.join(touched, self._same(table), "left_anti").select(*columns).unionByName(latest.filter("NOT row._gone").select(*(F.col("row")[c].alias(c) for c in columns)))

    def commit(self, changes: dict[str, Change], onto: int | None = None) -> int:
        """Writes the changes of all tables, then publishes them as one version. Raises if another writer was faster."""
        version = self.version() if onto is None else onto
        parts = self.manifest(version)
        written = {name: self._write(name, change) for name, change in changes.items()}
        self._publish(version + 1, {name: [*parts.get(name, []), *([written[name]] if name in written else [])] for name in self.tables})
        return version + 1

    def compact(self, name: str) -> int:
        """A version in which the table is one base again."""
        version = self.version()
        parts = self.manifest(version)
        path = self._write(name, Change(put=self.read(name, version)))
        self._publish(version + 1, {**parts, name: [path]})
        return version + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all manifests but the newest ``keep`` (one at least), and files that none of those names."""
        fs, newest = self._files(), self.version()
        kept = range(max(1, newest - max(1, keep) + 1), newest + 1)
        named = {p for v in kept for paths in self.manifest(v).values() for p in paths}
        gone = []
        for status in fs.listStatus(self._path("manifests")) if newest else []:
            number = status.getPath().getName().removesuffix(".json")
            if number.isdigit() and int(number) not in kept:
                fs.delete(status.getPath(), False)
        for name in self.tables:
            place = self._path("data", name)
            for status in fs.listStatus(place) if fs.exists(place) else []:
                path = f"data/{name}/{status.getPath().getName()}"
                if path not in named:
                    fs.delete(status.getPath(), True)
                    gone.append(path)
        return gone
