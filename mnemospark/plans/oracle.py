"""SQL for DuckDB that says what the queries compute, from the same word lists."""

from __future__ import annotations

from ..functions import thresholds as th
from ..functions import words as w
from . import memory_stream

WORD = r"[\p{L}\p{N}_]"
GAP = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def norm(t: str) -> str:
    return f"trim(regexp_replace({t}, '{GAP}', ' ', 'g'))"


def tokens(t: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(t)}, ' '), lambda x: x <> ''))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"


def compare_form(t: str) -> str:
    return norm(rf"regexp_replace(replace(lower({t}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x85\p{{Z}}]', ' ', 'g')")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(t: str, found: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, {quoted(x)})" for x in found) + ")"


def phrase(t: str, found: tuple[str, ...]) -> str:
    return f"regexp_matches({t}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(found)})($|[^\\p{{L}}\\p{{N}}_])')"


def all_tokens(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+'))"


def content(t: str) -> str:
    names = "[" + ", ".join(map(quoted, w.FUNCTION_WORDS + w.NUMBER_WORDS)) + "]"
    return f"list_filter({all_tokens(t)}, lambda x: NOT list_contains({names}, x) AND NOT regexp_matches(x, '^[0-9]+(st|nd|rd|th)?$'))"


def numbers(t: str) -> str:
    names = "[" + ", ".join(map(quoted, w.NUMBER_WORDS)) + "]"
    return f"list_filter({all_tokens(t)}, lambda x: regexp_matches(x, '[0-9]') OR list_contains({names}, x))"


def differ(a: str, b: str) -> str:
    return f"(len({a}) <> len({b}) OR len(list_intersect({a}, {b})) <> len({a}))"


def excerpt(t: str) -> str:
    return f"(CASE WHEN length({norm(t)}) > 120 THEN substring({norm(t)}, 1, 117) || '...' ELSE {norm(t)} END)"


def _class() -> str:
    clock = f"regexp_matches(low, {quoted(w.CLOCK)})"
    named = any_of("low", w.WEEKDAYS + w.MONTHS + w.OTHER_DAYS)
    date = f"({clock} OR {named} OR {any_of('low', w.ORDINALS + w.TERM_ENDS)})"
    has = lambda x: any_of("low", x)
    vital = " OR ".join((
        has(w.ACUTE), has(w.JEOPARDY), f"({has(w.CARE)} AND {phrase('low', (w.HARM,))})", f"({has(w.STOP_LOSS)} AND contains(low, '%'))",
        f"((contains(low, 'limit') OR contains(' ' || low || ' ', ' cap ')) AND {has(w.LIMIT_UNITS)})", f"({has(w.LEGAL)} AND ({date} OR {has(w.PROCEDURE)}))", f"({has(w.OBLIGATION)} AND {date})",
    ))
    routine = " OR ".join((
        has(w.ROUTINE), f"(contains(low, 'every') AND ({date} OR {has(w.RECURRENCE)}))", f"({has(w.SCHEDULE)} AND ({clock} OR {named}))", has(w.CAPACITY), f"({has(w.KEPT)} AND {has(w.LOCATIVE)})",
        f"({has(w.RECORD)} AND {date})",
    ))
    return f"""CASE WHEN low IN ({', '.join(map(quoted, w.FILLER))}) OR length(norm) <= 2 THEN 'filler'
      WHEN regexp_matches(low, '(^|[^a-z])(lol|lmao|rofl|(ha){{2,}})([^a-z]|$)') OR regexp_matches(low, '^i am [a-z][a-z ]{{0,20}}$') THEN 'play'
      WHEN contains(low, 'xxx') OR contains(low, '****') OR regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])\\p{{Nd}}{{6,}}($|[^\\p{{L}}\\p{{N}}_])') OR ({has(w.CONTACT)} AND regexp_matches(low, '\\p{{Nd}}')) THEN 'sensitive'
      WHEN {vital} THEN 'vital' WHEN {routine} THEN 'routine' ELSE 'uncertain' END"""


def votes() -> str:
    rows = ", ".join(f"('{n}', {v[0]}, {v[1]}, {v[2]}, {v[3]}, {v[4]}, {v[5]})" for n, v in th.VOTES.items())
    return f"(VALUES {rows}) v(class, durable, importance, stop, play, sensitive, conf)"


def gated(source: str, cutoffs: th.Gate | None = None, more: str = "") -> str:
    """CTEs ending in `gated`: source's rows with class, importance, action and reason; source has a column text."""
    c = cutoffs or th.Gate()
    return f"""source AS ({source}), low AS (SELECT *, lower(norm) AS low FROM (SELECT *, {norm('text')} AS norm FROM source)), classed AS (SELECT *, {_class()} AS class FROM low),
    gated AS (SELECT s.* EXCLUDE (class), s.class AS class, v.importance::INT AS importance,
      CASE WHEN conf < {c.min_conf} THEN 'QUARANTINE' WHEN play > {c.play_drop} THEN 'DROP' WHEN sensitive > {c.sensitive_drop} THEN 'DROP' WHEN stop >= {c.stop_block} THEN 'QUARANTINE'
        WHEN durable >= {c.durable_min} AND v.importance >= {c.importance_min} THEN 'STORE' ELSE 'DROP' END AS action,
      CASE WHEN conf < {c.min_conf} THEN 'uncertain-low-conf' WHEN play > {c.play_drop} THEN 'play>{c.play_drop:g}' WHEN sensitive > {c.sensitive_drop} THEN 'sensitive>{c.sensitive_drop:g}'
        WHEN stop >= {c.stop_block} THEN 'stop>={c.stop_block:g}' WHEN durable >= {c.durable_min} AND v.importance >= {c.importance_min} THEN 'durable+important' ELSE 'not-durable-or-trivial' END AS reason
      FROM classed s JOIN {votes()} ON s.class = v.class)"""


MEMORY = memory_stream.SQL


def votes_on(old: str, new: str) -> str:
    """strict and lenient votes as two columns."""
    same = f"lower({norm(old)}) = lower({norm(new)})"
    n, s, k = phrase(f"lower({new})", w.NEGATION), phrase(f"lower({new})", w.STRONG), phrase(f"lower({new})", w.WEAK)
    about = f"len(list_intersect({content(old)}, {content(new)})) >= {th.SHARED_TOKENS}"
    return f"""CASE WHEN {same} THEN 'same' WHEN {n} THEN CASE WHEN {about} THEN 'conflict_unresolved' ELSE 'unrelated' END WHEN {s} AND {about} THEN 'supersede' ELSE 'unrelated' END AS strict,
      CASE WHEN {same} THEN 'same' WHEN {s} OR {k} THEN 'supersede' WHEN {n} THEN 'conflict_unresolved' ELSE 'unrelated' END AS lenient"""


#: One row for each distinct admitted text of a user: the first.
ADMITTED = f"""{gated(MEMORY)}, admitted AS (SELECT user, seq, text FROM (SELECT user, seq, text, row_number() OVER (PARTITION BY user, norm ORDER BY seq) AS r FROM gated WHERE action = 'STORE') WHERE r = 1)"""

SUSPICIOUS = f"""{ADMITTED}, reading AS (SELECT user, seq, text, {norm('text')} AS norm, {tokens('text')} AS tokens, {content('text')} AS content, {numbers('text')} AS numbers,
    {phrase('lower(text)', w.NEGATION + w.STRONG + w.WEAK)} AS signal FROM admitted),
  paired AS (SELECT a.user AS scope, a.seq AS old_id, b.seq AS new_id, {jaccard('a.tokens', 'b.tokens')} AS score, a.text AS old_text, b.text AS new_text
    FROM reading a JOIN reading b ON a.user = b.user AND a.seq < b.seq
    WHERE a.norm <> b.norm AND {jaccard('a.tokens', 'b.tokens')} >= {th.SCREEN_JACCARD} AND (b.signal OR {differ('a.content', 'b.content')} OR {differ('a.numbers', 'b.numbers')})),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, new_id ORDER BY score DESC, old_id)::INT AS rank FROM paired),
  top AS (SELECT * FROM ranked WHERE rank <= {th.SCREEN_PAIRS}),
  voted AS (SELECT *, {votes_on('old_text', 'new_text')} FROM top)"""


#: The committee's action on two votes.
_ACTION = "CASE WHEN strict <> lenient THEN 'KEEP' WHEN strict = 'supersede' THEN 'TOMBSTONE' WHEN strict = 'conflict_unresolved' THEN 'CONFLICT' ELSE 'KEEP' END"


def folded(cap: int = th.MEMORY_CAP, bridge: bool = True, commands: str | None = None, lines: str | None = None) -> str:
    """CTEs (the WITH must be RECURSIVE) ending in `audit`, a row for each command, and `last`, each user's facts at the end:
    one user's commands in the order of seq, all users a command further at each step.

    commands selects user, seq, op, text, source, target_id, other_id; without it, lines (user, seq, text, source) are admitted, or the memory stream. A fact is
    known by k, the first command of its normal form, and has the seq of the command that made it as its id.
    """
    fact = "k BIGINT, id BIGINT, live BOOLEAN, text VARCHAR, source VARCHAR, created BIGINT, heir BIGINT, other BIGINT, importance INT, decided BIGINT"
    names = [x.split()[0] for x in fact.split(", ")]
    none = "NULL::BIGINT"

    def changed(**new: str) -> str:
        return "struct_pack(" + ", ".join(f"{n} := {new.get(n, 'f.' + n)}" for n in names) + ")"

    def each(*cases: str) -> str:
        return f"list_transform(facts, lambda f: CASE {' '.join(cases)} ELSE f END)"

    heard = {"source": "c_source", "importance": "c_importance", "decided": "c_decided"}
    again, revived = changed(**heard), changed(**heard, live="true", text="c_text", created="c_seq", heir=none, other=none)
    made = f"struct_pack(k := c_k, id := c_seq, live := true, text := c_text, source := c_source, created := c_seq, heir := {none}, other := (CASE WHEN len(against) > 0 THEN against[-1] END), importance := c_importance, decided := c_decided)"
    buried = f"WHEN f.id = c_target THEN {changed(live='false', heir='c_other')}"
    bridged = "true" if bridge else "false"
    admitting = f"""{gated(lines or MEMORY)}, given AS (SELECT user, seq, 'put' AS op, text, source, importance, seq AS decided, {none} AS target_id, {none} AS other_id FROM gated WHERE action = 'STORE')"""
    asked = f"""asked AS ({commands}), given AS (SELECT a.user, a.seq, a.op, CASE WHEN a.op IN ('release', 'approve') THEN h.text ELSE a.text END AS text, CASE WHEN a.op IN ('release', 'approve') THEN coalesce(a.source, h.source) ELSE a.source END AS source, NULL::INT AS importance, {none} AS decided, a.target_id, a.other_id
      FROM asked a LEFT JOIN asked h ON a.op IN ('release', 'approve') AND h.op = 'quarantine' AND h.user = a.user AND h.seq = a.target_id)"""
    audit = """SELECT g.user, g.seq, 'admit' AS op, CASE WHEN g.action = 'DROP' THEN 'drop' WHEN g.action = 'QUARANTINE' OR f.outcome = 'cap' THEN 'quarantine' ELSE f.outcome END AS outcome, f.fact_id, f.merged_into, f.score, f.flagged, f.cut, f.relations,
    CASE WHEN f.outcome = 'cap' THEN 'per-user-memory-cap' WHEN g.action <> 'STORE' THEN g.reason END AS reason FROM gated g LEFT JOIN fold f ON f.user = g.user AND f.seq = g.seq"""
    told = """SELECT user, seq, op, outcome, fact_id, merged_into, score, flagged, cut, relations, CASE outcome WHEN 'cap' THEN 'per-user-memory-cap' WHEN 'quarantine' THEN '' WHEN 'error' THEN CASE WHEN op IN ('retire', 'tombstone', 'mark_conflict') AND known THEN 'target required' ELSE 'unknown-id' END END AS reason FROM fold WHERE n > 0"""
    return f"""{asked if commands else admitting},
  numbered AS (SELECT *, {norm('text')} AS norm, row_number() OVER (PARTITION BY user ORDER BY seq) AS n, op IN ('put', 'supersede', 'release', 'approve') AS puts FROM given),
  stored AS (SELECT *, CASE WHEN puts THEN min(CASE WHEN puts THEN seq END) OVER (PARTITION BY user, norm) END AS k FROM numbered),
  reading AS (SELECT user, k, text, norm, {tokens('text')} AS tokens, {content('text')} AS content, {numbers('text')} AS numbers, {phrase('lower(text)', w.NEGATION + w.STRONG + w.WEAK)} AS signal FROM stored WHERE seq = k),
  paired AS (SELECT a.user AS user, a.k AS old_k, b.k AS new_k, {jaccard('a.tokens', 'b.tokens')} AS score, b.signal OR {differ('a.content', 'b.content')} OR {differ('a.numbers', 'b.numbers')} AS doubt, a.text AS old_text, b.text AS new_text
    FROM reading a JOIN reading b ON a.user = b.user AND a.k <> b.k WHERE {jaccard('a.tokens', 'b.tokens')} >= {th.SCREEN_JACCARD}),
  voted AS (SELECT user, old_k, new_k, score, doubt, {votes_on('old_text', 'new_text')} FROM paired),
  beside AS (SELECT user, new_k AS k, list(struct_pack(k := old_k, score := score, doubt := doubt, action := {_ACTION}, said := strict || ':' || {_ACTION} || ':' || CASE WHEN strict = lenient THEN strict || '-auto-spot' ELSE 'veto-keep' END) ORDER BY old_k) AS near FROM voted GROUP BY ALL),
  command AS MATERIALIZED (SELECT user AS c_user, n AS c_n, op AS c_op, k AS c_k, seq AS c_seq, text AS c_text, source AS c_source, importance AS c_importance, decided AS c_decided, target_id AS c_target, other_id AS c_other, coalesce(near, []) AS near FROM stored LEFT JOIN beside USING (user, k)),
  fold AS (
    SELECT DISTINCT user, 0::BIGINT AS n, {none} AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS outcome, false AS known, {none} AS fact_id, {none} AS merged_into, NULL::DOUBLE AS score, {none} AS flagged, {none} AS cut, NULL::VARCHAR AS relations, []::STRUCT({fact})[] AS facts, []::BIGINT[] AS held FROM stored
    UNION ALL
    SELECT user, c_n, c_seq, c_op, outcome, target IS NOT NULL, fact_id, CASE outcome WHEN 'exact' THEN own.id WHEN 'near' THEN best.id END, CASE outcome WHEN 'exact' THEN 1.0::DOUBLE WHEN 'near' THEN best.score END,
      CASE WHEN outcome = 'insert' AND {bridged} THEN len(flagged) END, CASE WHEN outcome = 'insert' AND {bridged} THEN greatest(len(flagged) - {th.SCREEN_PAIRS}, 0) END,
      CASE WHEN outcome = 'insert' AND {bridged} THEN array_to_string(list_transform(shown, lambda x: x.id || ':' || x.said), ',') END,
      CASE WHEN c_op = 'supersede' AND fact_id IS NOT NULL AND fact_id <> c_target AND target.k <> c_k THEN list_transform(after, lambda f: CASE WHEN f.id = c_target THEN {changed(live='false', heir='fact_id')} ELSE f END) ELSE after END,
      CASE WHEN outcome = 'quarantine' THEN list_append(held, c_seq) WHEN c_op IN ('release', 'approve', 'deny') AND outcome <> 'cap' THEN list_filter(held, lambda h: h <> c_target) ELSE held END
    FROM (SELECT *, CASE outcome WHEN 'insert' THEN c_seq WHEN 'near' THEN best.id WHEN 'exact' THEN own.id WHEN 'resurrect' THEN own.id WHEN 'cap' THEN NULL WHEN 'error' THEN NULL WHEN 'quarantine' THEN NULL WHEN 'deny' THEN NULL ELSE c_target END AS fact_id,
        CASE outcome WHEN 'exact' THEN {each(f'WHEN f.k = c_k THEN {again}')} WHEN 'near' THEN {each(f'WHEN f.k = best.k THEN {again}')}
          WHEN 'resurrect' THEN {each(f'WHEN f.k = c_k THEN {revived}', f'WHEN f.id = own.other AND f.other = own.id THEN {changed(other=none)}')}
          WHEN 'insert' THEN list_append({each(f"WHEN list_contains(gone, f.id) THEN {changed(live='false', heir='c_seq')}", f"WHEN list_contains(against, f.id) THEN {changed(other='c_seq')}")}, {made})
          WHEN 'restore' THEN {each(f"WHEN f.id = c_target THEN {changed(live='true', heir=none, other=none)}", f'WHEN f.id = target.other AND f.other = target.id THEN {changed(other=none)}')}
          WHEN 'retire' THEN {each(buried)} WHEN 'tombstone' THEN {each(buried)}
          WHEN 'mark_conflict' THEN {each(f"WHEN f.id = c_other THEN {changed(other='c_target')}", f"WHEN f.id = c_target THEN {changed(other='c_other')}")}
          ELSE facts END AS after
      FROM (SELECT *, list_transform(list_filter(shown, lambda x: x.action = 'TOMBSTONE'), lambda x: x.id) AS gone, list_transform(list_filter(shown, lambda x: x.action = 'CONFLICT'), lambda x: x.id) AS against
        FROM (SELECT *, flagged[:{th.SCREEN_PAIRS}] AS shown,
            CASE WHEN c_op IN ('supersede', 'restore', 'retire', 'tombstone', 'mark_conflict') AND target IS NULL THEN 'error' WHEN c_op IN ('retire', 'tombstone', 'mark_conflict') AND c_other IS NULL THEN 'error'
                WHEN c_op IN ('release', 'approve', 'deny') AND NOT coalesce(list_contains(held, c_target), false) THEN 'error'
              WHEN c_op IN ('restore', 'retire', 'tombstone', 'mark_conflict', 'quarantine', 'deny') THEN c_op
              WHEN own.live THEN 'exact' WHEN own IS NOT NULL THEN 'resurrect' WHEN best.score >= {th.DEDUP_JACCARD} THEN 'near' WHEN len(list_filter(facts, lambda f: f.live)) >= {cap} THEN 'cap' ELSE 'insert' END AS outcome
          FROM (SELECT *, CASE WHEN len(alike) > 0 THEN struct_pack(score := -list_sort(alike)[1].less, id := list_sort(alike)[1].id, k := list_sort(alike)[1].k) END AS best, CASE WHEN {bridged} THEN list_sort(list_filter(alike, lambda x: x.doubt)) ELSE list_filter(alike, lambda x: false) END AS flagged
            FROM (SELECT user, facts, held, command.*, list_filter(facts, lambda f: f.k = c_k)[1] AS own, list_filter(facts, lambda f: f.id = c_target)[1] AS target,
                list_transform(list_filter(facts, lambda f: f.live AND list_contains(list_transform(near, lambda x: x.k), f.k)),
                  lambda f: struct_pack(less := -near[list_position(list_transform(near, lambda x: x.k), f.k)].score, id := f.id, k := f.k, doubt := near[list_position(list_transform(near, lambda x: x.k), f.k)].doubt,
                    action := near[list_position(list_transform(near, lambda x: x.k), f.k)].action, said := near[list_position(list_transform(near, lambda x: x.k), f.k)].said)) AS alike
              FROM fold JOIN command ON c_user = user AND c_n = n + 1)))))),
  audit AS ({told if commands else audit}),
  last AS (SELECT user, unnest(facts) AS f FROM (SELECT user, arg_max(facts, n) AS facts FROM fold GROUP BY user))"""


def admitted(scope: str, calls: int, seconds: int, chars: int = th.CHARS_PER_WINDOW) -> str:
    """CTEs (RECURSIVE) and a SELECT: each event's call admitted or not against its scope's budget, in the order of time."""
    return f"""call AS MATERIALIZED (SELECT event_id AS c_key, ({scope})::BIGINT AS c_scope, epoch_us(ts) / 1e6::DOUBLE AS c_at, length(props) AS c_chars, row_number() OVER (PARTITION BY {scope} ORDER BY epoch_us(ts), event_id) AS c_n FROM events),
  fold AS (SELECT DISTINCT NULL::BIGINT AS key, c_scope AS scope, 0::BIGINT AS n, false AS admitted, 0::BIGINT AS retry_after, []::STRUCT(t DOUBLE, chars BIGINT)[] AS entries FROM call
    UNION ALL
    SELECT c_key, scope, c_n, fits, CASE WHEN fits THEN 0 ELSE greatest(1, trunc({seconds} - (c_at - coalesce(list_min(list_transform(kept, lambda e: e.t)), c_at)))::BIGINT + 1) END,
      CASE WHEN fits THEN list_append(kept, struct_pack(t := c_at, chars := c_chars)) ELSE kept END
    FROM (SELECT *, len(kept) < {calls} AND coalesce(list_sum(list_transform(kept, lambda e: e.chars)), 0) + c_chars <= {chars} AS fits
      FROM (SELECT *, list_filter(entries, lambda e: e.t > c_at - {seconds}) AS kept FROM fold JOIN call ON c_scope = scope AND c_n = n + 1)))
  SELECT key, scope, admitted, retry_after FROM fold WHERE n > 0"""
