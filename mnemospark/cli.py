"""Commands over a store folder: run, calibrate, conformal, override, review, approve, deny, redteam, demo, serve. Refusals exit 2."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo, facade
from .functions import gate
from .operators import contamination, evaluation, ledger, lifecycle
from .operators.redteam import LINES
from .sources import cases as generator
from .sources import tables



def redteam(spark: SparkSession) -> list[tuple[str, bool]]:
    """Five attacks and whether each was refused."""
    acted = {r[0] for r in spark.createDataFrame([(a,) for a in LINES], "t string").select(gate.gate(F.col("t"))["action"]).collect()}
    protected = spark.createDataFrame([("the blue bicycle stands in the north cellar",)], "text string")
    copied = spark.createDataFrame([("a", "The blue bicycle stands in the North cellar!")], "path string, s string")
    book = ledger.Ledger("u")
    book.apply({"seq": 1, "op": "put", "text": "the blue bicycle is in bay 2"})
    vague = book.apply({"seq": 2, "op": "put", "text": "everything in the bay moved"})
    other = ledger.Ledger("v").apply({"seq": 3, "op": "supersede", "text": "x", "target_id": 1})

    def halted(_: str):
        raise facade.JudgeHalted

    status, _ = facade.App(halted).handle("admit", {"user": "u", "text": "anything"})
    return [
        ("injection", "STORE" not in acted), ("paraphrase", contamination.flags(copied, protected).count() == 1), ("vague update", book.facts[1].tombstoned_by is None and "TOMBSTONE" not in (vague["relations"] or "")),
        ("another user", other["outcome"] == "error"), ("judge refused", status == 429),
    ]


def _cases(spark: SparkSession, path: str | None) -> DataFrame:
    return evaluation.split_cases(tables.read_cases(spark, path) if path else generator.generate(spark))


def run(spark: SparkSession, path: str | None, artifacts: str | None) -> int:
    """Scores cases by suite and split, after looking for test texts in artifacts."""
    cases = _cases(spark, path)
    if artifacts:
        protected = tables.case_strings(cases.where("split = 'test'")).select("text")
        files = tables.artifact_paths(spark, artifacts) or artifacts
        bad = [r for read in (tables.read_texts, tables.read_json) for r in contamination.scan(*read(spark, files), protected).collect()]
        for r in bad:
            print(f"{r.path} check={r.check} score={'n/a' if r.score is None else format(r.score, '.3f')} excerpt={r.excerpt!r}")
        if bad:
            return 2
    rows = evaluation.report(evaluation.predict(cases), "split").orderBy("suite", "split").collect()
    for r in rows:
        print(f"{r.suite:<12} {r.split:<6} n={r.n:<4} ok={r.ok:<4} fail={r.fail}")
    print(evaluation.cost_line())
    return int(any(r.fail for r in rows))


def change(spark: SparkSession, db: str, op: str, args: argparse.Namespace) -> int:
    """One command on the stored facts or the stored queue."""
    store = tables.Store(spark, db)
    facts, held = store.read("facts"), store.read("quarantine")
    if op in ("restore", "retire", "tombstone"):
        if facts.where(F.col("id") == args.fact_id).isEmpty() or (op != "restore" and args.target_id is None):
            print("refused: no such fact, or no target")
            return 2
        if op == "restore":
            conflicts = store.read("conflicts")
            new, left = lifecycle.restore(facts, conflicts, spark.createDataFrame([(args.fact_id,)], "id long"))
            store.write("conflicts", left)
        else:
            mark = spark.createDataFrame([(args.fact_id, args.target_id, args.reason or f"human-{op}", "human", 1)], "id long, by long, reason string, actor string, seq long")
            new = lifecycle.tombstone(facts, mark)
        store.write("facts", new)
        return 0
    item = held.where(F.col("id") == args.qid).head()
    if item is None or not (args.reason or "").strip():
        print("refused: no such item, or no reason")
        return 2
    if op == "approve":
        # The user's facts are folded once more, with the item as a put.
        mine = facts.where(F.col("user") == item.user).collect()
        book = ledger.Ledger(item.user, ledger.Settings(), {r.id: ledger.Fact(**{c: r[c] for c in ledger.Fact.__dataclass_fields__}) for r in mine})
        top = facts.agg(F.max("id")).head()[0] or 0
        if book.apply({"seq": top + 1, "op": "put", "text": item.text, "source": item.source})["outcome"] == "cap":
            print("refused: the memory is full")
            return 2
        rows = [tuple(f[c.strip().split(" ")[0]] for c in ledger.FACTS.split(",")) for f in book.dump()["facts"]]
        store.write("facts", facts.where(F.col("user") != item.user).unionByName(spark.createDataFrame(rows, ledger.FACTS)))
    reviews = store.read("reviews")
    n = (reviews.agg(F.max("id")).head()[0] or 0) + 1
    store.write("reviews", reviews.unionByName(spark.createDataFrame([(n, args.qid, op, args.reason.strip(), "human", n)], tables.SCHEMAS["reviews"])))
    store.write("quarantine", held.where(F.col("id") != args.qid))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mnemospark")
    sub = parser.add_subparsers(dest="verb", required=True)
    for verb in ("run", "calibrate", "conformal"):
        p = sub.add_parser(verb)
        p.add_argument("--cases")
        p.add_argument("--artifacts" if verb == "run" else "--out", required=verb != "run")
        p.add_argument("--task", default="general")
        p.add_argument("--gate", default="admit", choices=("admit", "importance"))
    p = sub.add_parser("override")
    p.add_argument("--db", required=True)
    p.add_argument("--action", required=True, choices=("restore", "retire", "tombstone"))
    p.add_argument("--fact-id", type=int, required=True)
    p.add_argument("--target-id", type=int)
    p.add_argument("--reason", default="")
    for verb in ("review", "approve", "deny"):
        p = sub.add_parser(verb)
        p.add_argument("--db", required=True)
        if verb != "review":
            p.add_argument("--qid", type=int, required=True)
            p.add_argument("--reason", required=True)
    sub.add_parser("redteam")
    sub.add_parser("demo")
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8765)
    p.add_argument("--kill-file")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.verb == "run":
        return run(spark, args.cases, args.artifacts)
    if args.verb in ("calibrate", "conformal"):
        suite = "admit" if args.verb == "calibrate" else args.gate
        train = _cases(spark, args.cases).where(F.col("split") == "train").where(F.col("suite") == suite)
        found = evaluation.calibrate_gate(train) if args.verb == "calibrate" else evaluation.calibrate_confidence(train, suite)
        tables.write_registry(args.out, args.task, found["thresholds"], **{k: v for k, v in found.items() if k.startswith("train")})
        print(f"wrote {args.out}: {found['thresholds']}")
        return 0
    if args.verb == "review":
        for r in tables.Store(spark, args.db).read("quarantine").orderBy("id").collect():
            print(f"{r.id} {r.user} {r.reason} {' '.join((r.text or '').split())[:120]}")
        return 0
    if args.verb == "redteam":
        found = redteam(spark)
        for name, good in found:
            print(f"{name:<14} {'PASS' if good else 'FAIL'}")
        return int(not all(good for _, good in found))
    if args.verb == "demo":
        print("\n".join(demo.transcript(spark)))
        return 0
    if args.verb == "serve":
        server = facade.serve(facade.App(rules(spark), kill_file=args.kill_file), args.host, args.port)
        server.serve_forever()
        return 0
    return change(spark, args.db, args.action if args.verb == "override" else args.verb, args)


def rules(spark: SparkSession):
    """The gate for single texts, by the same columns as for tables."""

    def decide(text: str) -> tuple[str, list[str], int | None]:
        d = spark.createDataFrame([(text,)], "t string").select(gate.gate(F.col("t")).alias("d")).head().d
        return d.action, list(d.reasons), d.importance

    return decide


if __name__ == "__main__":
    raise SystemExit(main())
