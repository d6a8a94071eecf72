"""The ordered life of facts: a fold over the commands of one user.

A command is a dict with seq, op and what the op needs (text, source, gate columns, target_id, other_id, reason). The
fold keeps the user's facts by id, the ids by hash, the live facts of each token, the open quarantine, reviews and
conflicts, and answers each command with one audit row. The same fold serves batches (run) and streams. A fact's id is
the seq of the command that made it, and a quarantined item's is the seq of the command that held it, so users never wait for each
other. The state of a user is bounded by the memory cap and by what was tombstoned. A fold begins empty or with what a store has of its
users (sources/log.py), and `advance` gives what it changed there.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, astuple, dataclass, field
from functools import cached_property
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gate, words
from ..functions import thresholds as th
from .limits import Budget

AUDIT = "user string, seq long, op string, outcome string, fact_id long, merged_into long, score double, flagged long, cut long, relations string, reason string"
FACTS = (
    "id long, user string, text string, text_hash string, source string, created long, tombstoned_by long, tombstone_reason string, tombstone_actor string, conflict_with long, "
    "gate_action string, importance int, judge string, decided_at long"
)
_EMPTY = dict.fromkeys(x.strip().split(" ")[0] for x in AUDIT.split(","))
_TOKEN = re.compile("[a-z0-9]+")
_ORDINAL = re.compile("^[0-9]+(st|nd|rd|th)?$")
_FUNCTION, _NUMBERS = frozenset(words.FUNCTION_WORDS), frozenset(words.NUMBER_WORDS)
_NEGATION, _STRONG, _WEAK = (re.compile(rf"\b(?:{'|'.join(p)})\b") for p in (words.NEGATION, words.STRONG, words.WEAK))


class Reading:
    """What the rules read in a text; each only where it is asked for, as a text that was said before needs its hash alone."""

    def __init__(self, text: str):
        self.text = text
        self.norm = " ".join(text.split())

    @cached_property
    def tokens(self) -> frozenset[str]:
        return frozenset(self.norm.split(" ")) if self.norm else frozenset()

    @cached_property
    def _low(self) -> str:
        return self.text.lower()

    @cached_property
    def _found(self) -> frozenset[str]:
        return frozenset(_TOKEN.findall(self._low))

    @cached_property
    def content(self) -> frozenset[str]:
        return frozenset(t for t in self._found if t not in _FUNCTION and t not in _NUMBERS and not _ORDINAL.match(t))

    @cached_property
    def numbers(self) -> frozenset[str]:
        return frozenset(t for t in self._found if t in _NUMBERS or any(c.isdigit() for c in t))

    @cached_property
    def negation(self) -> bool:
        return bool(_NEGATION.search(self._low))

    @cached_property
    def strong(self) -> bool:
        return bool(_STRONG.search(self._low))

    @cached_property
    def weak(self) -> bool:
        return bool(_WEAK.search(self._low))

    def hash(self) -> str:
        return hashlib.sha256(self.norm.encode()).hexdigest()


def committee(old: Reading, new: Reading, least_shared: int) -> tuple[str, bool, str]:
    """Relation, whether both voters agree, and action; the closed form of the two offline voters."""
    if old.norm.lower() == new.norm.lower():
        return "same", True, "KEEP"
    about = len(old.content & new.content) >= least_shared
    strict = ("conflict_unresolved" if about else "unrelated") if new.negation else "supersede" if new.strong and about else "unrelated"
    lenient = "supersede" if new.strong or new.weak else "conflict_unresolved" if new.negation else "unrelated"
    if strict != lenient:
        return strict, False, "KEEP"
    return strict, True, {"supersede": "TOMBSTONE", "conflict_unresolved": "CONFLICT"}.get(strict, "KEEP")


class JudgeHalted(Exception):
    """The judge couldn't vote: what was asked is held for review."""


class JudgeRefused(JudgeHalted):
    """The judge turned the question away for now."""


def committee_of_four(old: Reading, new: Reading, least_shared: int, live: tuple[str, str]) -> tuple[str, bool, str]:
    """As committee, with two live votes that must agree with each other and with the offline ones."""
    a, b = ("conflict_unresolved" if v == "contradict" else v for v in live)
    if not set(live) <= set(words.RELATIONS):
        return "unrelated", False, "KEEP"
    if live[0] != live[1]:
        return live[0], False, "KEEP"
    relation, agreed, action = committee(old, new, least_shared)
    if not agreed:
        return relation, False, "KEEP"
    return (relation, True, action) if relation == a == b else (a, False, "KEEP")


@dataclass
class Fact:
    id: int
    user: str
    text: str
    text_hash: str
    source: str
    created: int
    tombstoned_by: int | None = None
    tombstone_reason: str | None = None
    tombstone_actor: str | None = None
    conflict_with: int | None = None
    gate_action: str | None = None
    importance: int | None = None
    judge: str | None = None
    decided_at: int | None = None


class _OverBudget(Exception):
    """Nothing is left to ask the live judge with."""


@dataclass
class Settings:
    dedup_jaccard: float = th.DEDUP_JACCARD
    screen_jaccard: float = th.SCREEN_JACCARD
    screen_pairs: int = th.SCREEN_PAIRS
    shared_tokens: int = th.SHARED_TOKENS
    memory_cap: int | None = th.MEMORY_CAP
    bridge: bool = True
    #: Two live votes on (old text, new text), if they are to be asked, and the budget of characters that asking uses up.
    live: Callable[[str, str], tuple[str, str]] | None = None
    budget: Budget | None = None
    clock: Callable[[], float] = time.time


class Conflicts:
    """Conflicts in their order, and by the facts that are in them."""

    def __init__(self, found: Iterable[dict] = ()):
        self._items: dict[int, dict] = {}
        self._of: dict[int, set[int]] = {}
        self._next = 0
        for x in found:
            self.append(x)

    def append(self, x: dict) -> None:
        self._items[self._next] = x
        for i in (x["old_id"], x["new_id"]):
            self._of.setdefault(i, set()).add(self._next)
        self._next += 1

    def drop(self, i: int) -> None:
        """Without those that this fact is in."""
        for n in self._of.pop(i, ()):
            x = self._items.pop(n)
            for other in {x["old_id"], x["new_id"]} - {i}:
                self._of[other].discard(n)

    def __iter__(self) -> Iterator[dict]:
        return iter(self._items.values())

    def __len__(self) -> int:
        return len(self._items)


class Live:
    """Live facts by token, in arrays, so that similarities to all of them are counted at once.

    A fact keeps its place when it is retired; places of retired ones are given up once they are more than the live ones.
    """

    def __init__(self) -> None:
        self.readings: dict[int, Reading] = {}
        self._clear()

    def __len__(self) -> int:
        return len(self.readings)

    def _clear(self) -> None:
        self._place: dict[int, int] = {}
        self._by_token: dict[str, array] = {}
        self._names: dict = {}
        self._columns = {c: np.zeros(64, dtype=np.int64) for c in ("id", "size", "norm", "content", "numbers", "live")}

    def add(self, i: int, reading: Reading) -> None:
        self.readings[i] = reading
        if (at := self._place.get(i)) is not None:  # a text's normal form stays, whatever becomes of its fact
            self._columns["live"][at] = 1
            return
        at = self._place[i] = len(self._place)
        if at == len(self._columns["id"]):
            self._columns = {c: np.concatenate((v, np.zeros_like(v))) for c, v in self._columns.items()}
        name = lambda x: self._names.setdefault(x, len(self._names))
        row = (i, len(reading.tokens), name(reading.norm), name(("content", reading.content)), name(("numbers", reading.numbers)), 1)
        for column, x in zip(self._columns.values(), row, strict=True):
            column[at] = x
        for t in reading.tokens:
            self._by_token.setdefault(t, array("q")).append(at)

    def remove(self, i: int) -> None:
        del self.readings[i]
        self._columns["live"][self._place[i]] = 0
        if len(self._place) > 2 * len(self.readings) + 64:
            kept = self.readings
            self.readings = {}
            self._clear()
            for j, reading in kept.items():
                self.add(j, reading)

    def _found(self, new: Reading, least: float, lists: list[array]) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of live facts of at least this similarity to a text, of those that are in these lists of its tokens."""
        n = len(new.tokens)
        if not (some := [x for x in lists if len(x)]):
            return np.empty(0, dtype=np.int64), np.empty(0)
        both = np.bincount(np.concatenate([np.frombuffer(x, dtype=np.int64) for x in some]), minlength=len(self._place))
        at = np.flatnonzero((both >= least * n / (1 + least) - 1e-9) & (self._columns["live"][: len(both)] == 1))
        score = both[at] / (n + self._columns["size"][at] - both[at])
        near = score >= least
        return at[near], score[near]

    def best(self, new: Reading, least: float) -> tuple[float, int] | None:
        """(similarity, id) of the most alike, the smallest id of equals, or None below `least`.

        One that is so much alike has all tokens but so many as it may lack, and of any tokens as many; the rarest are looked at first.
        """
        lists = sorted((self._by_token.get(t, _NONE) for t in new.tokens), key=len)
        n = len(lists)
        lacks = n - max(1, int(np.ceil(least * n - 1e-9)))
        held = sum(map(len, lists[: lacks + 1]))
        if not held:
            return None
        k = lacks + 1
        while k < n and held + len(lists[k]) <= 4096:
            held += len(lists[k])
            k += 1
        some = np.flatnonzero(np.bincount(np.concatenate([np.frombuffer(x, dtype=np.int64) for x in lists[:k] if len(x)])) >= k - lacks)
        some = some[self._columns["live"][some] == 1]
        size = self._columns["size"][some]
        some = some[(size >= least * n - 1e-9) & (size * least <= n + 1e-9)]
        if not len(some):
            return None
        if len(some) > 32:
            at, score = self._found(new, least, lists)
            found = list(zip(score.tolist(), (-self._columns["id"][at]).tolist(), strict=True))
        else:
            found = []
            for i in self._columns["id"][some].tolist():
                tokens = self.readings[i].tokens
                both = len(new.tokens & tokens)
                if (score := both / (n + len(tokens) - both)) >= least:
                    found.append((score, -i))
        top = max(found, default=None)
        return top and (top[0], -top[1])

    def suspicious(self, new: Reading, least: float, most: int) -> tuple[int, list[int]]:
        """How many are alike and not equal, with a marker in the new text or another detail, and the ids of the most alike."""
        at, score = self._found(new, least, [self._by_token.get(t, _NONE) for t in new.tokens])
        c = self._columns
        doubt = c["norm"][at] != self._names.get(new.norm, -1)
        if not (new.negation or new.strong or new.weak):
            doubt &= (c["content"][at] != self._names.get(("content", new.content), -1)) | (c["numbers"][at] != self._names.get(("numbers", new.numbers), -1))
        score, ids = score[doubt], c["id"][at[doubt]]
        total = len(ids)
        if total > most > 0:
            near = score >= np.partition(score, total - most)[total - most]
            score, ids = score[near], ids[near]
        return total, ids[np.lexsort((ids, -score))][:most].tolist()


_NONE = array("q")


@dataclass
class Ledger:
    """One user's facts and what happened to them."""

    user: str
    settings: Settings = field(default_factory=Settings)
    facts: dict[int, Fact] = field(default_factory=dict)
    held: dict[int, dict] = field(default_factory=dict)
    conflicts: list[dict] = field(default_factory=list)
    reviews: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.by_hash: dict[str, int] = {f.text_hash: f.id for f in self.facts.values()}
        self.readings: dict[int, Reading] = {}
        self.alike = Live()
        self.conflicts = Conflicts(self.conflicts)
        #: Held items that no later command asks for, until flush() gives them away.
        self.passed: dict[int, dict] = {}
        self._loaded: dict = {"facts": {}, "held": set(), "conflicts": [], "reviews": 0}
        for f in self.facts.values():
            self.readings[f.id] = Reading(f.text)
            if f.tombstoned_by is None:
                self._index(f.id)

    def revisit(self, f: Fact) -> None:
        """Makes a tombstoned fact known that wasn't loaded with the others."""
        self.facts[f.id], self.readings[f.id], self.by_hash[f.text_hash] = f, Reading(f.text), f.id

    @property
    def live(self) -> int:
        return len(self.alike)

    def _index(self, i: int) -> None:
        self.alike.add(i, self.readings[i])

    def _unindex(self, i: int) -> None:
        self.alike.remove(i)

    def _judged(self, f: Fact, c: dict, overwrite: bool) -> None:
        """Provenance: a new life takes all of it, a repeated text what is given."""
        for name in ("gate_action", "importance", "judge", "decided_at"):
            if overwrite or c.get(name) is not None:
                setattr(f, name, c.get(name))

    def clear(self, i: int) -> None:
        """Back to a clean live fact: its own marks, the counterpart's if it still points here, and their conflicts."""
        f = self.facts[i]
        if f.tombstoned_by is not None:
            self._index(i)
        other = self.facts.get(f.conflict_with) if f.conflict_with is not None else None
        f.tombstoned_by = f.tombstone_reason = f.tombstone_actor = f.conflict_with = None
        if other is not None and other.conflict_with == i:
            other.conflict_with = None
        self.conflicts.drop(i)

    def tombstone(self, old: int, new: int | None, reason: str, actor: str) -> bool:
        f = self.facts.get(old)
        if f is None:
            return False
        if f.tombstoned_by is None:
            self._unindex(old)
        f.tombstoned_by, f.tombstone_reason, f.tombstone_actor = new, reason, actor
        return True

    def mark_conflict(self, old: int, new: int, reason: str, actor: str) -> None:
        self.conflicts.append({"old_id": old, "new_id": new, "relation": "conflict_unresolved", "reason": reason, "actor": actor})
        for a, b in ((old, new), (new, old)):
            if a in self.facts:
                self.facts[a].conflict_with = b

    def put(self, c: dict) -> dict:
        """Exact repeat, resurrection, near repeat, refusal at the cap, or a new fact, which is screened."""
        text, source = c["text"] or "", c.get("source") or ""
        new = Reading(text)
        h = new.hash()
        if (i := self.by_hash.get(h)) is not None:
            f = self.facts[i]
            if f.tombstoned_by is not None:
                f.text, f.source, f.created = text, source, c["seq"]
                self.readings[i] = new
                self.clear(i)
                self._judged(f, c, True)
                return {"outcome": "resurrect", "fact_id": i}
            f.source = source
            self._judged(f, c, False)
            return {"outcome": "exact", "fact_id": i, "merged_into": i, "score": 1.0}
        if best := self.alike.best(new, self.settings.dedup_jaccard):
            f = self.facts[best[1]]
            f.source = source
            self._judged(f, c, False)
            return {"outcome": "near", "fact_id": f.id, "merged_into": f.id, "score": best[0]}
        if self.settings.memory_cap is not None and self.live >= self.settings.memory_cap:
            return {"outcome": "cap", "reason": "per-user-memory-cap"}
        i = c["seq"]
        f = self.facts[i] = Fact(i, self.user, text, h, source, c["seq"])
        self._judged(f, c, True)
        self.by_hash[h], self.readings[i] = i, new
        flagged, kept = self.alike.suspicious(new, self.settings.screen_jaccard, self.settings.screen_pairs) if self.settings.bridge else (0, [])
        self._index(i)
        return {"outcome": "insert", "fact_id": i} | (self.screen(i, new, flagged, kept) if self.settings.bridge else {})

    def screen(self, i: int, new: Reading, flagged: int, kept: list[int]) -> dict:
        """Shows suspicious live facts to the committee, most alike first, and applies what it agrees on."""
        outcomes = []
        for at, j in enumerate(kept):
            if self.facts[j].tombstoned_by is not None:
                outcomes.append(f"{j}:unrelated:KEEP:stale-target-skipped")
                continue
            try:
                relation, agreed, action = self._ask(j, i, new)
            except (JudgeHalted, _OverBudget) as e:
                # The run stops here, and every pair that wasn't asked is named.
                first, rest = {_OverBudget: ("rate-budget-exhausted",) * 2, JudgeRefused: ("judge-rate-limited", "judge-halted-skipped")}.get(type(e), ("judge-halted", "judge-halted-skipped"))
                outcomes += [f"{k}:unrelated:KEEP:{first if n == 0 else rest}" for n, k in enumerate(kept[at:])]
                break
            reason = f"{relation}-auto-spot" if agreed else "veto-keep"
            if agreed and action == "TOMBSTONE":
                self.tombstone(j, i, reason, "auto-spot")
            elif agreed and action == "CONFLICT":
                self.mark_conflict(j, i, reason, "auto-spot")
            outcomes.append(f"{j}:{relation}:{action}:{reason}")
        return {"flagged": flagged, "cut": max(0, flagged - self.settings.screen_pairs), "relations": ",".join(outcomes)}

    def _ask(self, old: int, i: int, new: Reading) -> tuple[str, bool, str]:
        s = self.settings
        if s.live is None:
            return committee(self.readings[old], new, s.shared_tokens)
        a, b = self.facts[old].text, self.facts[i].text
        if s.budget is not None and not s.budget.check(s.clock(), len(a) + len(b))[0]:
            raise _OverBudget
        return committee_of_four(self.readings[old], new, s.shared_tokens, s.live(a, b))

    def hold(self, c: dict, reason: str) -> dict:
        item = {"qid": c["seq"], "text": c["text"], "reason": reason, "source": c.get("source") or ""}
        (self.held if c.get("asked", True) or c["seq"] in self.held else self.passed)[c["seq"]] = item
        return {"outcome": "quarantine", "reason": reason}

    def admit(self, c: dict) -> dict:
        if c.get("gate_action") == "STORE":
            done = self.put({**c, "decided_at": c["seq"]})
            return self.hold(c, done["reason"]) if done["outcome"] == "cap" else done
        if c.get("gate_action") == "QUARANTINE":
            return self.hold(c, c.get("reason") or "")
        return {"outcome": "drop", "reason": c.get("reason")}

    def supersede(self, c: dict) -> dict:
        """Puts the new text and retires the old fact, unless the text is the old one's or merges into it."""
        old = self.facts.get(c.get("target_id"))
        if old is None:
            return {"outcome": "error", "reason": "unknown-id"}
        same = " ".join((c["text"] or "").split()) == " ".join(old.text.split())
        done = self.put(c)
        if not same and done.get("fact_id") is not None and done["fact_id"] != old.id:
            self.tombstone(old.id, done["fact_id"], c.get("reason") or "supersede", "code")
        return done

    def decide_held(self, c: dict, op: str) -> dict:
        """approve, deny or release of a quarantined item; at the cap it stays held."""
        item = self.held.get(c.get("target_id"))
        if op != "release" and not (c.get("reason") or "").strip():
            return {"outcome": "error", "reason": "a reason is required"}
        if item is None:
            return {"outcome": "error", "reason": "unknown-id"}
        done = {"outcome": op}
        if op != "deny":
            done = self.put({"seq": c["seq"], "text": item["text"], "source": c.get("source") or item["source"]})
            if done["outcome"] == "cap":
                return done
        del self.held[item["qid"]]
        if op != "release":
            self.reviews.append({"qid": item["qid"], "decision": op, "reason": c["reason"].strip(), "actor": "human"})
        return done

    def override(self, c: dict, op: str) -> dict:
        i = c.get("target_id")
        if i not in self.facts:
            return {"outcome": "error", "reason": "unknown-id"}
        if op == "restore":
            self.clear(i)
        elif c.get("other_id") is None:
            return {"outcome": "error", "reason": "target required"}
        elif op == "mark_conflict":
            self.mark_conflict(i, c["other_id"], c.get("reason") or "conflict_unresolved", "code")
        else:
            self.tombstone(i, c["other_id"], c.get("reason") or f"human-{op}", "human")
        return {"outcome": op, "fact_id": i}

    def apply(self, c: dict) -> dict:
        """Runs one command; its audit row."""
        op = c["op"]
        if op in ("admit", "put", "supersede"):
            done = getattr(self, op)(c)
        elif op in ("approve", "deny", "release"):
            done = self.decide_held(c, op)
        elif op in ("restore", "retire", "tombstone", "mark_conflict"):
            done = self.override(c, op)
        elif op == "quarantine":
            done = self.hold(c, c.get("reason") or "")
        else:
            done = {"outcome": "error", "reason": "unknown-op"}
        return _EMPTY | {"user": self.user, "seq": c["seq"], "op": op} | done

    def dump(self) -> dict:
        return {"facts": [asdict(f) for f in self.facts.values()], "held": list(self.held.values()), "conflicts": list(self.conflicts), "reviews": self.reviews}

    def begin(self) -> Ledger:
        """From here on changes() counts."""
        self._loaded = {"facts": {f.id: astuple(f) for f in self.facts.values()}, "held": set(self.held), "conflicts": [dict(x) for x in self.conflicts], "reviews": len(self.reviews)}
        return self

    def flush(self, whole: bool) -> list[dict]:
        """Held items that won't be asked for; but for the last, unless this is the whole, as another command may have its seq."""
        if not whole and len(self.passed) < 2:
            return []
        last = None if whole else next(reversed(self.passed))
        given = [x for k, x in self.passed.items() if k != last]
        self.passed = {} if whole else {last: self.passed[last]}
        return given

    def rows(self, part: str) -> Iterator[dict]:
        """The stored rows of a part as they stand, one after another."""
        if part == "facts":
            return (dict(vars(f)) for f in self.facts.values())
        return iter({"held": self.held.values(), "conflicts": self.conflicts, "reviews": self.reviews}[part])

    def changes(self) -> dict[str, Iterator[dict]]:
        """What differs from the state at begin(), as rows of the stored tables, made where they are read; gone marks rows to be removed.

        Conflicts are numbered in their order, as a pair may come twice.
        """
        was, old = self._loaded, self._loaded["conflicts"]
        facts = ({**vars(f), "gone": False} for f in self.facts.values() if was["facts"].get(f.id) != astuple(f))
        held = chain(({**x, "gone": False} for k, x in self.held.items() if k not in was["held"]), ({"qid": k, "gone": True} for k in sorted(was["held"] - set(self.held))))
        conflicts = ({"n": i, **x, "gone": False} for i, x in enumerate(self.conflicts) if i >= len(old) or old[i] != x)
        conflicts = chain(conflicts, ({"n": i, "gone": True} for i in range(len(self.conflicts), len(old))))
        return {"facts": facts, "held": held, "conflicts": conflicts, "reviews": ({**x, "gone": False} for x in self.reviews[was["reviews"] :])}

    @classmethod
    def load(cls, user: str, state: dict, settings: Settings) -> Ledger:
        return cls(user, settings, {f["id"]: Fact(**f) for f in state["facts"]}, {h["qid"]: h for h in state["held"]}, state["conflicts"], state["reviews"])


COMMAND = ("user", "seq", "op", "text", "source", "gate_action", "importance", "judge", "reason", "target_id", "other_id")
_TYPES = {"seq": "long", "importance": "int", "target_id": "long", "other_id": "long"}


def commands(df: DataFrame) -> DataFrame:
    """df with every column of a command; what is missing is null, op is admit, and commands without a user are those of `local`."""
    have = set(df.columns)
    default = {"op": F.lit("admit")}
    out = df.select(*[(F.col(c) if c in have else default.get(c, F.lit(None))).cast(_TYPES.get(c, "string")).alias(c) for c in COMMAND])
    return out.withColumn("user", F.coalesce("user", F.lit("local")))


def gated(df: DataFrame, cutoffs: th.Gate | None = None) -> DataFrame:
    """Adds what the gate says of each text to commands, so the fold doesn't read rules for admission."""
    d = gate.gate(F.col("text"), cutoffs)
    return df.withColumn("__d", d).withColumns({"gate_action": F.col("__d.action"), "importance": F.col("__d.importance"), "judge": F.col("__d.judge"), "reason": F.array_join("__d.reasons", ";")}).drop("__d")


#: What a user's state is stored as; (user, the second column) is the key of a row.
STATE = {
    "facts": FACTS,
    "held": "qid long, user string, text string, reason string, source string",
    "conflicts": "n long, user string, old_id long, new_id long, relation string, reason string, actor string",
    "reviews": "qid long, user string, decision string, reason string, actor string",
}
_SHAPES = {
    "audit": AUDIT, "facts": FACTS, "held": "user string, qid long, text string, reason string, source string",
    "conflicts": "user string, old_id long, new_id long, relation string, reason string, actor string", "reviews": "user string, qid long, decision string, reason string, actor string",
}
_KINDS = ("facts", "held", "conflicts")
#: Rows of a batch that a fold gives of its state.
GIVEN = 4096


def _columns(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(",")]


def state_rows(stored: dict[str, DataFrame]) -> DataFrame:
    """user, kind (its number), seq and item (JSON) of stored facts, held items and conflicts: what a fold needs of the past."""
    parts = [stored[k].select("user", F.lit(i).alias("kind"), F.col(_columns(STATE[k])[0]).alias("seq"), F.to_json(F.struct(*_columns(STATE[k]))).alias("item")) for i, k in enumerate(_KINDS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def loaded(user: str, items: list[tuple[int, str]], rules: Settings) -> Ledger:
    """The ledger of a user from its state rows (kind, item), in the order of seq."""
    found: dict[str, list[dict]] = {k: [] for k in _KINDS}
    for kind, item in items:
        found[_KINDS[kind]].append(json.loads(item))
    facts = {f["id"]: Fact(**f) for f in found["facts"]}
    held = {h["qid"]: {"qid": h["qid"], "text": h.get("text"), "reason": h.get("reason"), "source": h.get("source")} for h in found["held"]}
    return Ledger(user, rules, facts, held, [{c: x.get(c) for c in ("old_id", "new_id", "relation", "reason", "actor")} for x in found["conflicts"]]).begin()


def _ordered(df: DataFrame, stored: dict[str, DataFrame] | None) -> DataFrame:
    """Each user's stored state and then its commands in the order of seq, in one partition.

    Scanned in order, neither need be held in memory at once.
    """
    # Items that nobody will ask for needn't be held until the end; a fold gives them away as it goes on.
    asks = df.where(F.col("op").isin("approve", "deny", "release")).select(F.col("user").alias("__user"), F.col("target_id").alias("__seq")).distinct().withColumn("__asked", F.lit(True))
    known = df.where("seq is not null").join(asks, (F.col("user") == F.col("__user")) & (F.col("seq") == F.col("__seq")), "left").drop("__user", "__seq")
    known = known.withColumns({"asked": F.coalesce("__asked", F.lit(False)), "kind": F.lit(len(_KINDS)), "item": F.lit(None).cast("string")}).drop("__asked")
    if stored:
        past = state_rows(stored).join(df.select("user").distinct(), "user", "left_semi")
        known = known.unionByName(past, allowMissingColumns=True)
    return known.repartition("user").sortWithinPartitions("user", "kind", "seq")


def _folded(batches: Iterator[pa.RecordBatch], rules: Settings) -> Iterator[tuple[Ledger, list[dict], bool]]:
    """(ledger, audit rows of this batch, whether the user is done)."""
    ledger: Ledger | None = None
    user, past = None, []
    rows: list[dict] = []
    for batch in batches:
        names = batch.schema.names
        columns = [[None] * batch.num_rows if x.null_count == batch.num_rows else x.to_pylist() for x in batch.columns]
        for values in zip(*columns, strict=True):
            c = dict(zip(names, values, strict=True))
            if user != c["user"] and (ledger is not None or past):
                yield ledger or loaded(user, past, rules), rows, True
                ledger, past, rows = None, [], []
            user = c["user"]
            if c["kind"] < len(_KINDS):
                past.append((c["kind"], c["item"]))
                continue
            if ledger is None:
                ledger, past = loaded(user, past, rules), []
            rows.append(ledger.apply(c))
        if ledger is not None and rows:
            yield ledger, rows, False
            rows = []
    if ledger is not None:
        yield ledger, rows, True


def run(df: DataFrame, output: str = "audit", settings: Settings | None = None, stored: dict[str, DataFrame] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Folds commands (user, seq, op, ...) user by user in the order of seq.

    output: audit (a row for each command), facts, held, conflicts or reviews of users with commands as they stand at the
    end; columns: those that are wanted, if not all. stored: facts, held and conflicts to go on from, with the columns of STATE. A user's commands are one group: that
    is the order that results depend on; users are spread over tasks. A command without seq has no place in that order: it
    changes nothing, and its audit row is an error.
    """
    rules, schema = settings or Settings(), _SHAPES[output]
    if columns:
        kinds = dict(x.strip().split(" ") for x in schema.split(","))
        schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    names = _columns(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ledger, rows, done in _folded(batches, rules):
            given = ledger.flush(done)
            if output == "audit":
                yield _batch(rows, names, schema)
                continue
            for some in batched(chain(given if output == "held" else (), ledger.rows(output) if done else ()), GIVEN):
                yield _batch([{"user": ledger.user, **x} for x in some], names, schema)

    known = commands(df)
    done = _ordered(known, stored).mapInArrow(fold, schema)
    return done.unionByName(refused(known).select(*names)) if output == "audit" else done


#: One row of a fold that gives all at once: which table, and a column for a row of each.
_ALL = "part string, " + ", ".join(f"{k} struct<{', '.join(x.strip().replace(' ', ': ') for x in v.split(','))}>" for k, v in {"audit": AUDIT, **{k: v + ", gone boolean" for k, v in STATE.items()}}.items())


def advance(df: DataFrame, settings: Settings | None = None, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """One fold for all tables: part, and in the column of that name an audit row or a changed row of the stored tables.

    Rows of the tables have the columns of STATE and gone, true for keys to be removed. Write it before it is read more than once.
    """
    rules = settings or Settings()
    shapes = {"audit": AUDIT, **{k: v + ", gone boolean" for k, v in STATE.items()}}
    kinds = {k: pa.struct([(n, _ARROW[t]) for n, t in (x.strip().split(" ") for x in v.split(","))]) for k, v in shapes.items()}

    def shown(part: str, rows: list[dict]) -> pa.RecordBatch:
        n, names = len(rows), _columns(shapes[part])
        filled = pa.array([{c: r.get(c) for c in names} for r in rows], type=kinds[part])
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part), n), *(filled if k == part else pa.nulls(n, kinds[k]) for k in shapes)], names=["part", *shapes])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ledger, rows, done in _folded(batches, rules):
            if rows:
                yield shown("audit", rows)
            changed = {"held": ({**x, "gone": False} for x in ledger.flush(done))}
            for part, found in chain(changed.items(), ledger.changes().items() if done else ()):
                for some in batched(found, GIVEN):
                    yield shown(part, [{**x, "user": ledger.user} for x in some])

    known = commands(df)
    late = refused(known).select(F.lit("audit").alias("part"), F.struct(*_columns(AUDIT)).alias("audit"))
    return _ordered(known, stored).mapInArrow(fold, _ALL).unionByName(late, allowMissingColumns=True)


def refused(known: DataFrame) -> DataFrame:
    """Audit rows of commands without a place in the order."""
    fixed = {"user": F.col("user"), "op": F.col("op"), "outcome": F.lit("error"), "reason": F.lit("no-seq")}
    return known.where("seq is null").select(*[fixed.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.strip().split(" ") for x in AUDIT.split(","))])


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(rows: list[dict], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [_ARROW[x.strip().split(" ")[1]] for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=k) for n, k in zip(names, kinds, strict=True)], names=names)
