"""Synthetic cases by templates: as many of each suite as asked for, the same ones each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import CASE

PLACES = ("harbour", "garden", "attic", "studio", "cellar", "library", "kitchen", "workshop")
THINGS = ("lantern", "kettle", "ladder", "bicycle", "compass", "piano", "telescope", "easel")


def generate(spark: SparkSession, per_kind: int = 10) -> DataFrame:
    """Cases with labels that the rules give by construction; an even number of each suite and kind splits evenly."""
    rows: list[dict] = []

    def add(suite: str, kind: str, expect: str, **fields) -> None:
        rows.append({"id": f"{suite}-{kind}-{sum(r['suite'] == suite and r['kind'] == kind for r in rows):04d}", "suite": suite, "kind": kind, "provenance": "synthetic-rule", "expect": expect, **fields})

    for i in range(per_kind):
        p, t, n = PLACES[i % 8], THINGS[i // 8 % 8], i + 1
        add("admit", "routine", "STORE", text=f"i always keep the {t} in the {p} row {n}")
        add("admit", "play", "DROP", text=f"the {t} in the {p} was fun lol {n}")
        add("admit", "sensitive", "DROP", text=f"the {t} account number for the {p} is {700000 + n}")
        add("admit", "uncertain", "QUARANTINE", text=f"the {t} in the {p} looked plain row {n}")
        add("importance", "vital", "5", text=f"the {p} {t} renewal deadline is friday {n}")
        add("importance", "routine", "4", text=f"i prefer the {t} of the {p} shelf {n}")
        add("dedupe", "dup", "DUP", text=f"the {t} stands in the {p} row {n}", candidate=f"  row {n} the {p} in the stands {t} ")
        add("dedupe", "distinct", "DISTINCT", text=f"the {t} stands in the {p} row {n}", candidate=f"a {p} holds one {t} at place {n}")
        add("contradict", "conflict", "CONFLICT", old=f"the {p} {t} is open in row {n}", new=f"the {p} {t} is not open in row {n}")
        add("contradict", "keep", "KEEP", old=f"the {p} {t} is open in row {n}", new=f"lunch was not good {n}")
        add("supersede", "tombstone", "TOMBSTONE", old=f"the {p} {t} is in row {n}", new=f"the {p} {t} moved to row {n + 1}")
        add("supersede", "keep", "KEEP", old=f"the {p} {t} is in row {n}", new=f"everything moved {n}")
        add("rerank", "order", f'["{t} {n}","{p} {n}"]', candidates=[[f"{p} {n}", "0.7"], [f"{t} {n}", "0.9"], ["low", "0.2"]])
    return spark.createDataFrame([tuple(r.get(c.strip().split(" ")[0]) for c in CASE.split(", ")) for r in rows], CASE)
