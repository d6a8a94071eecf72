"""The admission gate as columns: a text's class, the vote of its class, and the decision on a vote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import thresholds as th
from . import words as w
from .text import WORD, contains_any, normalize

VOTE = ("durable", "importance", "stop", "play", "sensitive", "conf")
JUDGE = "stub:RuleJudge"


def _is_date(low: Column) -> Column:
    return low.rlike(w.CLOCK) | contains_any(low, w.WEEKDAYS + w.MONTHS + w.OTHER_DAYS + w.ORDINALS + w.TERM_ENDS)


def is_play(norm: Column, low: Column) -> Column:
    """Laughter, or a line that only claims to be someone."""
    return low.rlike(r"(?<![a-z])(lol|lmao|rofl|(ha){2,})(?![a-z])") | (low.rlike("^i am [a-z][a-z ]{0,20}$") & F.substring(norm, 6, 1).rlike(r"\p{L}"))


def is_sensitive(low: Column) -> Column:
    long_number = low.rlike(rf"(?<!{WORD})\p{{Nd}}{{6,}}(?!{WORD})")
    return low.contains("xxx") | low.contains("****") | long_number | (contains_any(low, w.CONTACT) & low.rlike(r"\p{Nd}"))


def is_vital(low: Column) -> Column:
    """What does harm if forgotten: a pairing of signs, or an acute sign alone."""
    date = _is_date(low)
    return (
        contains_any(low, w.ACUTE)
        | contains_any(low, w.JEOPARDY)
        | (contains_any(low, w.CARE) & low.rlike(rf"(?<!{WORD})({w.HARM})(?!{WORD})"))
        | (contains_any(low, w.STOP_LOSS) & low.contains("%"))
        | ((low.contains("limit") | F.concat(F.lit(" "), low, F.lit(" ")).contains(" cap ")) & contains_any(low, w.LIMIT_UNITS))
        | (contains_any(low, w.LEGAL) & (date | contains_any(low, w.PROCEDURE)))
        | (contains_any(low, w.OBLIGATION) & date)
    )


def is_routine(low: Column) -> Column:
    """A standing fact worth keeping."""
    date = _is_date(low)
    return (
        contains_any(low, w.ROUTINE)
        | (low.contains("every") & (date | contains_any(low, w.RECURRENCE)))
        | (contains_any(low, w.SCHEDULE) & (low.rlike(w.CLOCK) | contains_any(low, w.WEEKDAYS + w.MONTHS + w.OTHER_DAYS)))
        | contains_any(low, w.CAPACITY)
        | (contains_any(low, w.KEPT) & contains_any(low, w.LOCATIVE))
        | (contains_any(low, w.RECORD) & date)
    )


def classify(text: Column) -> Column:
    """filler, play, sensitive, vital, routine or uncertain; the first that fits. A null text is an empty one.

    The rules read the normal form and its lower case many times. They are bound as variables of a lambda, so that a
    plan which moves this expression (into a filter or a join's condition) still makes each of them once.
    """

    def rules(norm: Column, low: Column) -> Column:
        return (
            F.when(low.isin(*w.FILLER) | (F.length(norm) <= 2), "filler")
            .when(is_play(norm, low), "play")
            .when(is_sensitive(low), "sensitive")
            .when(is_vital(low), "vital")
            .when(is_routine(low), "routine")
            .otherwise("uncertain")
        )

    def once(norm: Column) -> Column:
        return F.get(F.transform(F.array(F.lower(norm)), lambda low: rules(norm, low)), F.lit(0))

    return F.get(F.transform(F.array(normalize(F.coalesce(text, F.lit("")))), once), F.lit(0))


def vote_struct(values: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("int" if n == "importance" else "double").alias(n) for n, v in zip(VOTE, values, strict=True)])


def vote_of(kind: Column) -> Column:
    """The vote of a class; anything else fails closed. The class is read once, from a constant map."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for n, v in th.VOTES.items() for x in (F.lit(n), vote_struct(v))]), kind), vote_struct(th.FAIL_CLOSED))


def _cutoff(x: float) -> str:
    return f"{x:g}"


def decide(vote: Column, cutoffs: th.Gate | None = None, judge: str = JUDGE) -> Column:
    """struct(action, reasons, importance, judge) of a vote; the first branch that fits."""
    c = cutoffs or th.Gate()

    def make(action: str, reason: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.array(F.lit(reason)).alias("reasons"), vote["importance"].alias("importance"), F.lit(judge).alias("judge"))

    return (
        F.when(vote["conf"] < c.min_conf, make("QUARANTINE", "uncertain-low-conf"))
        .when(vote["play"] > c.play_drop, make("DROP", f"play>{_cutoff(c.play_drop)}"))
        .when(vote["sensitive"] > c.sensitive_drop, make("DROP", f"sensitive>{_cutoff(c.sensitive_drop)}"))
        .when(vote["stop"] >= c.stop_block, make("QUARANTINE", f"stop>={_cutoff(c.stop_block)}"))
        .when((vote["durable"] >= c.durable_min) & (vote["importance"] >= c.importance_min), make("STORE", "durable+important"))
        .otherwise(make("DROP", "not-durable-or-trivial"))
    )


def decide_class(kind: Column, cutoffs: th.Gate | None = None) -> Column:
    """The decision on a class: a constant for each."""
    return F.element_at(F.create_map(*[x for n, v in th.VOTES.items() for x in (F.lit(n), decide(vote_struct(v), cutoffs))]), kind)


def gate(text: Column, cutoffs: th.Gate | None = None) -> Column:
    """The decision on a text by the rules; the text is classified once."""
    return decide_class(classify(text), cutoffs)


def recorded_vote(found: Column) -> Column:
    """A vote looked up in a table of votes; where there is none, it fails closed."""
    return F.coalesce(found, vote_struct(th.FAIL_CLOSED))
