"""The ledger's fold over a stream: the same commands, the same audit rows, and views of what it keeps.

A user's state is keyed: live facts by id (the memory cap bounds them), tombstoned ones by the hash of their text, with
their ids beside them, held items and reviews by id, conflicts by their number. A micro-batch reads a user's live facts, held items and
conflicts, and of the tombstoned facts only those whose text or id it meets; it writes back what it changed. So what a batch costs
follows its commands and what is open, however many facts were tombstoned; those stay in the state store on disk, as a text that
comes again revives its fact. Rows of a micro-batch are ordered by seq; across batches the order of arrival stands.

A stream may begin with what a store has (sources/log.py): its rows are the initial state, read once, in the first batch.
Facts, held items, conflicts and reviews as they stand after the last finished batch are read from the checkpoint (view),
by Spark's state data source, while the stream runs or after it has stopped.

The state store is RocksDB (audit sets it for the session): keyed state asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import AUDIT, FACTS, STATE, Fact, Ledger, Settings, commands, loaded, refused, state_rows

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONFLICT = ("old_id", "new_id", "relation", "reason", "actor")
_LONGS = ("seq", "importance", "target_id", "other_id")


class _Known(dict):
    """A dict that looks further where a key is missing, and keeps what it finds."""

    def __init__(self, found: dict, further: Callable):
        super().__init__(found)
        self.further = further

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __missing__(self, key):
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def get(self, key, default=None):
        if not super().__contains__(key):
            found = self.further(key)
            if found is None:
                return default
            self[key] = found
        return super().__getitem__(key)


class _Processor(StatefulProcessor):
    def __init__(self, rules: Settings):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "id long", FACTS)
        self.dead = handle.getMapState("dead", "text_hash string", FACTS)
        self.dead_ids = handle.getMapState("dead_ids", "id long", "text_hash string")
        self.held = handle.getMapState("held", "qid long", "text string, reason string, source string")
        self.conflicts = handle.getMapState("conflicts", "n long", "old_id long, new_id long, relation string, reason string, actor string")
        self.reviews = handle.getMapState("reviews", "qid long", "decision string, reason string, actor string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """Takes the stored rows of a user as its state."""
        ledger = loaded(key[0], [(int(k), item) for k, item in zip(initialState["kind"], initialState["item"], strict=True)], self.rules)
        for f in ledger.facts.values():
            if f.tombstoned_by is None:
                self.live.updateValue((f.id,), astuple(f))
            else:
                self.dead.updateValue((f.text_hash,), astuple(f))
                self.dead_ids.updateValue((f.id,), (f.text_hash,))
        for qid, x in ledger.held.items():
            self.held.updateValue((qid,), (x["text"], x["reason"], x["source"]))
        for n, x in enumerate(ledger.conflicts):
            self.conflicts.updateValue((n,), tuple(x[c] for c in _CONFLICT))

    def _ledger(self, user: str) -> tuple[Ledger, dict[int, tuple]]:
        """The user's ledger with its live facts, and every fact as it was read."""
        before: dict[int, tuple] = {}

        def read(row: tuple) -> Fact:
            fact = Fact(*row)
            before[fact.id] = astuple(fact)
            return fact

        def by_hash(h: str) -> int | None:
            if not self.dead.containsKey((h,)):
                return None
            fact = read(self.dead.getValue((h,)))
            if not dict.__contains__(ledger.facts, fact.id):
                ledger.revisit(fact)
            return fact.id

        def by_id(i: int) -> Fact | None:
            if i is None or not self.dead_ids.containsKey((int(i),)):
                return None
            fact = read(self.dead.getValue(self.dead_ids.getValue((int(i),))))
            ledger.revisit(fact)
            return fact

        facts = {f.id: f for f in (read(tuple(v)) for _, v in self.live.iterator())}
        held = {k[0]: {"qid": k[0], "text": v[0], "reason": v[1], "source": v[2]} for k, v in self.held.iterator()}
        conflicts = [dict(zip(_CONFLICT, v, strict=True)) for _, v in sorted((k[0], tuple(v)) for k, v in self.conflicts.iterator())]
        ledger = Ledger(user, self.rules, facts, held, conflicts)
        ledger.facts, ledger.by_hash = _Known(ledger.facts, by_id), _Known(ledger.by_hash, by_hash)
        return ledger, before

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger, before = self._ledger(key[0])
        held, conflicts = set(ledger.held), [dict(x) for x in ledger.conflicts]
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [ledger.apply({k: None if pd.isna(v) else int(v) if k in _LONGS else v for k, v in r.items()}) for r in frame.to_dict("records")]
        for fact in dict.values(ledger.facts):
            now, was = astuple(fact), before.get(fact.id)
            if now == was:
                continue
            was_dead = was is not None and was[6] is not None
            if fact.tombstoned_by is None:
                self.live.updateValue((fact.id,), now)
                if was_dead:
                    self.dead.removeKey((fact.text_hash,))
                    self.dead_ids.removeKey((fact.id,))
            else:
                self.dead.updateValue((fact.text_hash,), now)
                if not was_dead:
                    self.dead_ids.updateValue((fact.id,), (fact.text_hash,))
                    if was is not None:
                        self.live.removeKey((fact.id,))
        for gone in held - set(ledger.held):
            self.held.removeKey((gone,))
        for qid in set(ledger.held) - held:
            item = ledger.held[qid]
            self.held.updateValue((qid,), (item["text"], item["reason"], item["source"]))
        for n, x in enumerate(ledger.conflicts):
            if n >= len(conflicts) or conflicts[n] != x:
                self.conflicts.updateValue((n,), tuple(x[c] for c in _CONFLICT))
        for n in range(len(ledger.conflicts), len(conflicts)):
            self.conflicts.removeKey((n,))
        for x in ledger.reviews:
            self.reviews.updateValue((x["qid"],), (x["decision"], x["reason"], x["actor"]))
        done = pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in AUDIT.split(",")])
        for c in ("fact_id", "merged_into", "flagged", "cut"):
            done[c] = done[c].astype("Int64")
        yield done

    def close(self) -> None:
        pass


def audit(stream: DataFrame, settings: Settings | None = None, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Audit rows of a stream of commands (user, seq, op, ...), one user's state at a time.

    stored: facts, held and conflicts (the columns of ledger.STATE) that the stream's first start begins with; a stream that goes on from
    its checkpoint has them already.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    known = commands(stream)
    past = state_rows(stored).groupBy("user") if stored else None
    done = known.where("seq is not null").groupBy("user").transformWithStateInPandas(_Processor(settings or Settings()), AUDIT, "append", "None", past)
    return done.unionByName(refused(known))


def view(spark: SparkSession, checkpoint: str, table: str) -> DataFrame:
    """facts, live, held, conflicts or reviews as the stream's last finished batch left them, with the columns of ledger.STATE."""
    if table == "facts":
        return view(spark, checkpoint, "live").unionByName(view(spark, checkpoint, "dead"))
    # The checkpoint names the state store that wrote it, but the reader asks the session.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    schema = STATE.get(table, FACTS)
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", table).load()
    key = {"live": None, "dead": None, "held": "qid", "conflicts": "n", "reviews": "qid"}[table]
    names = [x.strip().split(" ") for x in schema.split(",")]
    given = {"user": F.col("key.user"), **({key: F.col(f"user_map_key.{key}")} if key else {})}
    return rows.select(*[(given[n] if n in given else F.col(f"user_map_value.{n}")).cast(t).alias(n) for n, t in names])
