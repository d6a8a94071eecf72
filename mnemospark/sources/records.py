"""Records of a run with a live judge: a report in Markdown, and the votes as JSON that later runs are held against."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation

#: Suites in which a judge votes.
JUDGED = ("admit", "importance", "contradict", "supersede")


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """One text file, wherever Spark can write: its lines go out one by one, and it stands under its name when it is whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    for line in lines:
        out.write(bytearray(f"{line}\n".encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(part, where)


def case_lines(rows: DataFrame) -> DataFrame:
    """gate, id, line of (gate, id, stub, live, label): what each judge said of a case, and whether they agree."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    mark = F.when(F.col("stub").eqNullSafe(F.col("live")), "agree").otherwise("differ")
    return rows.select("gate", "id", F.format_string("- %s stub=%s live=%s label=%s %s", F.col("id"), shown("stub"), shown("live"), shown("label"), mark).alias("line"))


def write_calibration(path: str, rows: DataFrame, style: str, model: str, stamp: str, total: int | None = None) -> str:
    """The report of a calibration: agreement by gate, then each case. total says how many cases a halted run should have had."""
    done = rows.count()

    def lines() -> Iterator[str]:
        yield f"# Calibration {stamp} ({style}, {model})"
        yield ""
        yield "For information: agreement rates decide nothing."
        if total is not None and done < total:
            yield f"Halted at the judge's limit after {done} of {total} cases; the numbers are partial."
        yield ""
        yield from (f"- {x}" for x in evaluation.agreement_lines(rows))
        gate = None
        for r in case_lines(rows).orderBy("gate", "id").toLocalIterator():
            if r.gate != gate:
                gate = r.gate
                yield from ("", f"## {gate}")
            yield r.line

    write_lines(rows.sparkSession, path, lines())
    return path


def vote_summary(rows: DataFrame) -> DataFrame:
    """One row of (id, stub, live): agree_count, total and agreement in words."""
    told = rows.agg(F.coalesce(F.sum(F.col("stub").eqNullSafe(F.col("live")).cast("long")), F.lit(0)).alias("agree_count"), F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, 100.0 * F.col("agree_count") / F.nullif(F.col("total"), F.lit(0))).otherwise(0.0)
    return told.withColumn("agreement", F.format_string("%d/%d = %.1f%%", F.col("agree_count"), F.col("total"), share))


def write_votes(path: str, rows: DataFrame, model: str, date: str) -> dict:
    """The votes of a sample as JSON, with how far they agree; the sample is as small as what a live judge is paid for."""
    summary = vote_summary(rows).head().asDict()
    payload = {**summary, "date": date, "model": model, "votes": {r.id: r.live for r in rows.select("id", "live").orderBy("id").collect()}}
    write_lines(rows.sparkSession, path, json.dumps(payload, indent=1, ensure_ascii=False).split("\n"))
    return payload
