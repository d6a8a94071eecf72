"""Tables of facts, cases and artifacts: schemas, readers and writers."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, words
from ..operators.ledger import FACTS
from ..operators.lifecycle import migrate
from ..operators.metrics import fingerprint

SCHEMAS = {
    "facts": FACTS,
    "quarantine": "id long, text string, reason string, source string, user string, created long",
    "conflicts": "id long, old_id long, new_id long, relation string, reason string, actor string, created long",
    "reviews": "id long, qid long, decision string, reason string, actor string, created long",
}
CASE = "id string, suite string, kind string, provenance string, text string, candidate string, old string, new string, candidates array<array<string>>, gate double, expect string"
TEXT_ENDINGS = ("yaml", "yml", "toml", "txt", "md")


class Store:
    """Tables in a folder, each a series of Parquet snapshots; a reader sees the last one that was finished.

    A snapshot is written whole under a new name, and then named in the table's `current` file, so a failed write leaves
    the table as it was and a table can be written from its own rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(name)
        return where, where.getFileSystem(conf)

    def _current(self, table: str) -> str | None:
        where, fs = self._file(f"{self.path}/{table}/current")
        if not fs.exists(where):
            return None
        return self.spark.read.text(f"{self.path}/{table}/current").head()[0]

    def read(self, table: str) -> DataFrame:
        """The table with every column of its schema; empty if nothing was written."""
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        name = self._current(table)
        if name is None:
            return empty
        found = self.spark.read.parquet(f"{self.path}/{table}/{name}")
        return migrate(found, empty) if table == "facts" else empty.unionByName(found, allowMissingColumns=True)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replaces the table; facts are laid out by user, the key of every scope."""
        name = f"snapshot-{uuid.uuid4().hex}"
        (rows.repartition("user").sortWithinPartitions("user", "id") if table == "facts" else rows).write.parquet(f"{self.path}/{table}/{name}")
        temp, fs = self._file(f"{self.path}/{table}/.next-{name}")
        out = fs.create(temp, True)
        out.write(bytearray(name.encode()))
        out.close()
        where, _ = self._file(f"{self.path}/{table}/current")
        fs.delete(where, False)
        fs.rename(temp, where)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases, one JSON object a line; blank lines are skipped, other broken ones stop the read."""
    return spark.read.schema(CASE).option("mode", "FAILFAST").json(path)


def validate_cases(cases: DataFrame, provenance: str) -> DataFrame:
    """id, problem of cases with an unknown suite, no kind or another provenance."""
    c = F.col
    problem = (
        F.when(~F.coalesce(c("suite").isin(*words.SUITES), F.lit(False)), F.concat(F.lit("unknown suite "), F.coalesce("suite", F.lit("null"))))
        .when(F.coalesce("kind", F.lit("")) == "", "missing kind")
        .when(~F.coalesce(c("provenance") == provenance, F.lit(False)), F.concat(F.lit("provenance "), F.coalesce("provenance", F.lit("null"))))
    )
    return cases.select("id", problem.alias("problem")).where("problem is not null")


def case_strings(cases: DataFrame) -> DataFrame:
    """id, text: every text of a case."""
    listed = F.filter(F.concat(F.array("text", "candidate", "old", "new"), F.coalesce(F.transform("candidates", lambda x: x[0]), F.array())), lambda t: t.isNotNull())
    return cases.select("id", F.explode(listed).alias("text"))


def artifact_paths(spark: SparkSession, root: str, extra: str | None = None) -> list[str]:
    """The files that a registry may have been tuned on: all in thresholds, and those of eval that are named so; and one more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = {extra} if extra else set()
    for ending in ("json", *TEXT_ENDINGS):
        for place in (f"thresholds/*.{ending}", f"eval/thresholds*.{ending}"):
            where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{place}")
            found |= {f.getPath().toString() for f in where.getFileSystem(conf).globStatus(where) or []}
    return sorted(found)


def read_texts(spark: SparkSession, path: str | list[str], endings: tuple[str, ...] = TEXT_ENDINGS) -> tuple[DataFrame, DataFrame]:
    """(strings, bodies) of text artifacts: the stripped whole and its distinct stripped lines, if there is anything; (path, body, is_json)."""
    files = spark.read.option("pathGlobFilter", "*.{" + ",".join(endings) + "}").option("recursiveFileLookup", True).text(path, wholetext=True)
    bodies = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.lit(False).alias("is_json"))
    strings = bodies.select("path", F.explode(F.array_distinct(F.concat(F.transform(text.lines(F.col("body")), lambda x: text.strip(x)), F.array(text.strip(F.col("body")))))).alias("s")).where("s != ''")
    return strings, bodies


def read_json(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(strings, bodies) of JSON artifacts: every string value at any depth. A file that isn't JSON stops the read."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    bodies = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.lit(True).alias("is_json"))

    def strings_of(value) -> list[str]:
        if isinstance(value, str):
            return [value]
        return [s for v in (value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()) for s in strings_of(v)]

    def walk(batches):
        for pdf in batches:
            rows = [(p, s) for p, b in zip(pdf["path"], pdf["body"], strict=True) for s in sorted(set(strings_of(json.loads(b))))]
            yield pdf.iloc[:0][["path"]].reindex(range(len(rows))).assign(path=[r[0] for r in rows], s=[r[1] for r in rows])

    return bodies.select("path", "body").mapInPandas(walk, "path string, s string"), bodies


class RegistryError(Exception):
    """A registry that isn't this task's."""


def write_registry(path: str, task: str, thresholds: dict[str, float], **more) -> dict:
    """One JSON file for a task, with the fingerprint that it is checked by."""
    registry = {"task": task, "fingerprint": fingerprint(task), "thresholds": thresholds, **more}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(registry, indent=2))
    return registry


def read_registry(path: str, task: str) -> dict:
    if not Path(path).exists():
        raise RegistryError(f"no registry for {task}")
    registry = json.loads(Path(path).read_text())
    if registry.get("task") != task or registry.get("fingerprint") != fingerprint(task):
        raise RegistryError(f"the registry of {registry.get('task')} isn't for {task}")
    return registry


def threshold(registry: dict | None, key: str, task: str) -> float | str:
    """A tuned threshold, or UNCALIBRATED."""
    if registry is None:
        return "UNCALIBRATED"
    if registry.get("task") != task:
        raise RegistryError(f"the registry isn't for {task}")
    return registry.get("thresholds", {}).get(key, "UNCALIBRATED")
