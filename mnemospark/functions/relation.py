"""How a new fact bears on an old one: two offline voters, the committee, and the committee of four."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import thresholds as th
from . import words
from .text import content_tokens, flat, has_change_signal, has_negation, has_strong_update, has_weak_update, normalize, number_tokens, set_jaccard, sets_differ, token_set


def shared_content(old: Column, new: Column) -> Column:
    return F.size(F.array_intersect(content_tokens(old), content_tokens(new)))


def strict_vote(old: Column, new: Column, least_shared: int = th.SHARED_TOKENS) -> Column:
    """Believes a marker only between texts that share content; reads negation first."""
    about = shared_content(old, new) >= least_shared
    return (
        F.when(flat(old) == flat(new), "same")
        .when(has_negation(new), F.when(about, "conflict_unresolved").otherwise("unrelated"))
        .when(has_strong_update(new) & about, "supersede")
        .otherwise("unrelated")
    )


def lenient_vote(old: Column, new: Column) -> Column:
    """Believes every marker; reads updates first."""
    return (
        F.when(flat(old) == flat(new), "same").when(has_strong_update(new) | has_weak_update(new), "supersede").when(has_negation(new), "conflict_unresolved").otherwise("unrelated")
    )


def canonical(vote: Column) -> Column:
    return F.when(vote == "contradict", "conflict_unresolved").otherwise(vote)


def _decision(relation: Column, agreed: bool, action: Column, reasons: Column) -> Column:
    return F.struct(relation.alias("relation"), F.lit(agreed).alias("agreed"), action.alias("action"), reasons.alias("reasons"))


def _veto(relation: Column, *reasons: str) -> Column:
    return _decision(relation, False, F.lit("KEEP"), F.array(*map(F.lit, reasons)))


def _agreed(relation: Column, *more: str) -> Column:
    action = F.when(relation == "supersede", "TOMBSTONE").when(relation == "conflict_unresolved", "CONFLICT").otherwise("KEEP")
    first = F.when(relation == "conflict_unresolved", "conflict-unresolved-never-tombstone").otherwise(F.concat(relation, F.lit("-agreed")))
    return _decision(relation, True, action, F.array(first, *map(F.lit, more)))


def _known(*votes: Column) -> Column:
    out = F.lit(True)
    for v in votes:
        out = out & F.coalesce(v.isin(*words.RELATIONS), F.lit(False))
    return out


def committee(a: Column, b: Column) -> Column:
    """struct(relation, agreed, action, reasons) of two votes: nothing is done unless they agree."""
    return F.when(~_known(a, b), _veto(F.lit("unrelated"), "invalid-label-veto")).when(a != b, _veto(a, "disagree-veto")).otherwise(_agreed(canonical(a)))


def committee_of_four(live_a: Column, live_b: Column, offline_a: Column, offline_b: Column) -> Column:
    """As committee, of two live votes and two offline ones: each pair must agree, and the pairs with each other."""
    live, offline = canonical(live_a), canonical(offline_a)
    return (
        F.when(~_known(live_a, live_b), _veto(F.lit("unrelated"), "invalid-label-veto"))
        .when(live_a != live_b, _veto(live_a, "disagree-veto", "live-pair-disagree"))
        .when(~_known(offline_a, offline_b), _veto(F.lit("unrelated"), "invalid-label-veto"))
        .when(offline_a != offline_b, _veto(offline_a, "disagree-veto", "offline-pair-disagree"))
        .when(live != offline, _veto(live, "disagree-veto", "live-offline-disagree"))
        .otherwise(_agreed(live, "live-plus-offline-agreed"))
    )


def offline_decision(old: Column, new: Column) -> Column:
    return committee(strict_vote(old, new), lenient_vote(old, new))


def is_suspicious(old: Column, new: Column, least: float = th.SCREEN_JACCARD) -> Column:
    """Alike, not equal, and a marker in the new text or another detail; the cheap tests come first."""
    return (
        (normalize(old) != normalize(new))
        & (set_jaccard(token_set(old), token_set(new)) >= least)
        & (has_change_signal(new) | sets_differ(content_tokens(old), content_tokens(new)) | sets_differ(number_tokens(old), number_tokens(new)))
    )
