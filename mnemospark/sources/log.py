"""Keyed tables with a log of commits: rows are added, replaced and removed by key, and several tables change at once.

    <path>/log/00000000000000000007.json     one commit: for each table, the folder of its rows; base if nothing before counts
    <path>/<table>/<name>/bucket=<b>/*.parquet

Rows are dealt to buckets by their user. A commit first writes its rows under a new name and then its entry, which appears
whole (written beside the log, moved there if no entry has that number), so a reader sees all of a commit or none, and a writer that
fails at any step leaves the tables as they were. Two writers who began at one version ask for one number: the second is
refused (Refused) and may begin anew. A read merges the commits since the last base: of the rows of one key that of the latest
commit counts, unless it is marked gone. What is read for some buckets, users or keys is filtered in the scan, before the merge.

compact() writes all that counts as a new base, under the same rules, and expire() removes what no kept version needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(Exception):
    """Another writer has made the commit that this one was to be."""


class Log:
    """tables: name to schema, whose first column and `user` are a row's key."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._conf = jvm, conf
        self._fs = self._at("").getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def bucket(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def _key(self, table: str) -> str:
        return self.tables[table].split()[0]

    # --- entries ----------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of all commits."""
        where = self._at("log")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The last commit's number, -1 if there is none."""
        return max(self.versions(), default=-1)

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"log/{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def entries(self, version: int | None = None) -> list[tuple[int, dict]]:
        """(number, entry) of the commits that a read of this version merges, from the last base on."""
        out: list[tuple[int, dict]] = []
        for v in reversed([v for v in self.versions() if version is None or v <= version]):
            out.append((v, self._entry(v)))
            if out[-1][1]["base"]:
                break
        return out[::-1]

    def _publish(self, version: int, entry: dict) -> None:
        self._fs.mkdirs(self._at("log"))
        temp, final = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{version:020d}.json")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self._spark_array(self._jvm.org.apache.hadoop.fs.Options.Rename, [])
        try:
            files.rename(temp, final, none)  # fails if there is such an entry
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Refused(f"commit {version} was made by another writer") from e
            raise

    def _spark_array(self, kind, values: list):
        out = self.spark.sparkContext._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    # --- writing ----------------------------------------------------------------------------------------------------

    def _written(self, table: str, rows: DataFrame) -> str:
        """Writes rows under a new name, a bucket's together; a bucket that is much larger than others is split."""
        name = uuid.uuid4().hex
        names = [x.split()[0] for x in self.tables[table].split(", ")]
        gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
        dealt = rows.select(*names, gone.alias("gone"), self.bucket(F.col("user")).alias("bucket")).hint("rebalance", F.col("bucket"))
        dealt.sortWithinPartitions("bucket", "user", self._key(table)).write.partitionBy("bucket").parquet(f"{self.path}/{table}/{name}")
        return name

    def commit(self, changes: dict[str, DataFrame], after: int, base: bool = False) -> int:
        """Makes rows of some tables (with `gone` where keys are to be removed) the commit after version `after`; its number.

        Of rows that share a key in one commit any counts. Raises Refused if there is a later commit; its own rows are removed then.
        """
        if self.version() != after:
            raise Refused(f"version {after} isn't the last one")
        names = {table: self._written(table, rows) for table, rows in changes.items()}
        try:
            self._publish(after + 1, {"base": base, "tables": names})
        except Refused:
            for table, name in names.items():
                self._fs.delete(self._at(f"{table}/{name}"), True)
            raise
        return after + 1

    def compact(self) -> int:
        """Writes what counts as a base, so a read merges nothing before it; its number."""
        last = self.version()
        return self.commit({t: self.read(t, last) for t in self.tables}, last, base=True)

    def expire(self, keep: int = 1) -> int:
        """Removes entries and rows that none of the last `keep` versions needs, and rows that no entry names; how many folders.

        Rows of a commit that is being written have no entry yet: run it while no writer is at work.
        """
        versions = self.versions()
        if not versions:
            return 0
        first = self.entries(versions[max(0, len(versions) - keep)])[0][0]
        needed = {(t, n) for v in versions if v >= first for t, n in self._entry(v)["tables"].items()}
        for v in versions:
            if v < first:
                self._fs.delete(self._at(f"log/{v:020d}.json"), False)
        removed = 0
        for t in self.tables:
            for f in self._fs.listStatus(self._at(t)) if self._fs.exists(self._at(t)) else []:
                if (t, f.getPath().getName()) not in needed:
                    self._fs.delete(f.getPath(), True)
                    removed += 1
        return removed

    # --- reading ----------------------------------------------------------------------------------------------------

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None, where: Column | None = None) -> DataFrame:
        """The table's rows at a version (the last one). buckets: only these; where: a condition on user and key.

        Both are applied to each commit's files, so Spark leaves out other buckets and tests the condition in the scan.
        """
        schema, key = self.tables[table], ["user", self._key(table)]
        parts = []
        for v, entry in self.entries(version):
            if table in entry["tables"]:
                found = self.spark.read.schema(f"{schema}, gone boolean, bucket int").parquet(f"{self.path}/{table}/{entry['tables'][table]}")
                if buckets is not None:
                    found = found.where(F.col("bucket").isin(list(buckets)))
                parts.append((found if where is None else found.where(where)).withColumn("__v", F.lit(v).cast("long")))
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        names = [x.split()[0] for x in schema.split(", ")]
        if len(parts) > 1:
            rest = [n for n in names if n not in key]
            last = F.max_by(F.struct(*rest, "gone"), "__v").alias("__last")
            out = out.groupBy(*key).agg(last).select(*key, "__last.*")
        return out.where("not gone").select(*names)

    def get(self, table: str, user: str, key: int) -> DataFrame:
        """One row by its key, from one bucket."""
        mine = self.bucket(F.lit(user))
        return self.read(table, where=(F.col("bucket") == mine) & (F.col("user") == user) & (F.col(self._key(table)) == key))
