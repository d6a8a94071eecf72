"""Mixing, divergence and the manifest against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import divergence, manifest, mixing, ranks, registry

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["gid", "at", "n", "size", "term", "docs", "digest", "leaf", "target", "taken", "items", "path", "place", "chance", "block", "group"]


def table(spark, rows):
    """Documents, with columns beside them whose names the operators use, too."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})


def odd(seed, n, sources=("a", "b", "é", "z", "", None)):
    rng = random.Random(seed)
    words = [*"alpha Beta gamma DELTA été 日本 x1y don't".split(), "\n", "\t", "a\nb"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " \n ", "one", "\n"]) if rng.random() < 0.15 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        source = sources[0] if rng.random() < 0.4 else rng.choice(sources)
        rows.append((i, text, rng.choice(["en", "de", "", None]), source, rng.choice([None, len(text or "")])))
    rows += [rows[0]] * 5 + [(3, "another", "en", "a", 7), (None, "no id\n", "en", "b", 1), (None, None, None, None, None), (n + 1, "long word\n" * 30000, "en", "a", 300000)]
    rng.shuffle(rows)
    return rows


# --- places ---------------------------------------------------------------------------------------------------------


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40)) for _ in range(900)]
    got = ranks.placed(spark.createDataFrame(rows, "g string, k int"), ["g"], [F.col("k").asc()], "test").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    assert len({r.gid for r in got}) == 3 == len({(r.g, r.gid) for r in got})
    for g, found in by.items():
        found.sort(key=lambda r: r["at"])
        assert [r["at"] for r in found] == list(range(len(found))) and {r.n for r in found} == {len(found)}
        assert [r.k for r in found] == sorted(k for x, k in rows if x == g)


# --- 11 -------------------------------------------------------------------------------------------------------------


def brute_targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return sizes, target


def check_mix(rows, got, exact):
    sizes, target = brute_targets(rows)
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((r[0], len((r[1] or "").encode().split())) for r in rows), key=repr)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= exact(s), (s, taken[s], target[s])


def test_mixing_takes_what_sources_are_to_give(spark):
    rows = odd(3, 400)
    check_mix(rows, mixing.mix(table(spark, rows)).collect(), lambda s: 60000 if s == "a" else 60)  # one document outweighs its source
    rows = [r for r in rows if len(r[1] or "") < 10000]
    got = mixing.mix(table(spark, rows)).collect()
    small = {s: sorted(len((r[1] or "").split()) for r in rows if r[3] == s and r[1] and r[1].split())[:3] for s in {r[3] for r in rows}}
    check_mix(rows, got, lambda s: sum(small[s]) + 1)


def test_mixing_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    small = {s: sum(sorted(r.size for r in got if r.source == s)[:3]) for s in {r[3] for r in rows}}
    check_mix(rows, got, lambda s: small[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "MERGE", 4)
    rows = [(i, "w " * (1 + i * 7 % 50), "en", "hot" if i % 3 else "b", 0) for i in range(1500)]
    got = mixing.mix(table(spark, rows)).collect()
    check_mix(rows, got, lambda s: 3)
    share = {s: target / size for (s, target), size in zip(brute_targets(rows)[1].items(), brute_targets(rows)[0].values(), strict=True)}
    for s in ("hot", "b"):  # documents are balanced, too
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies for r in mine) - share[s] * len(mine)) <= 3


def test_landing_comes_near_with_one_large_document():
    rng = np.random.default_rng(2)
    for k in range(300):
        size = np.sort(np.concatenate(([5000.0], rng.integers(10, 90, 30).astype(float))))[::-1]
        chance = np.full(31, rng.random() * 0.98 + 0.01)
        pi = mixing.landing(size, mixing.flight(size, chance, rng), wanted := float(size @ chance))
        assert set(pi) <= {0.0, 1.0}
        others = size[1:].sum()  # the large one stays out, or all others do, if they can't make up for it
        assert abs(size @ pi - wanted) <= max(0, min(abs(wanted - 5000), wanted - others)) + 200, (k, chance[0])


def test_chances_are_kept():
    size = np.sort(np.random.default_rng(0).integers(1, 60, 40)).astype(float)[::-1]
    chance = np.full(40, 0.3)
    runs = [mixing.flight(size, chance, np.random.default_rng(k)) for k in range(2000)]
    for pi in runs[:200]:
        assert abs(pi.sum() - chance.sum()) < 1e-6 and abs(size @ pi - size @ chance) < 1e-6 and ((pi > 0) & (pi < 1)).sum() <= 2
    assert np.abs(np.mean(runs, axis=0) - 0.3).max() < 0.05


def test_mixing_nothing(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    got = mixing.mix(table(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_sizes_of_long_texts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mixing, "CHUNK", 10)
    texts = [None, "", "a", " a b ", "x" * 50, "a\x0bb\x85c d", "é é\n", "\t\r\n", "last one "]
    assert mixing.word_counts(pa.array(texts)).tolist() == [len((t or "").encode().split()) for t in texts]
    assert mixing.word_counts(pa.array(texts).slice(3, 4)).tolist() == [len((t or "").encode().split()) for t in texts[3:7]]
    assert mixing.word_counts(pa.array([], pa.string())).tolist() == []


# --- 12 -------------------------------------------------------------------------------------------------------------


def brute_audit(rows, least=10, top=10):
    having, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        having.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in having.items() if g == lang and n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in [None, *[s for g, s in groups if g == lang]]}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in total}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in total:
            if s is None:
                continue
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in total if o not in (s, None)))
            term = sorted(((-f(p[s][t], p[None][t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]))[:top]
            out += [(lang, s, part, i.decode(), -v, r + 1) for part, found in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("width", [1 << 24, 64])
def test_divergence(spark, monkeypatch, width):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "BITS", 32768)
    rows = odd(7, 300)
    got = divergence.audit(table(spark, rows), width=width)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows)


def test_divergence_nothing(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    rows = [(1, None, None, None, None), (2, "few words", "en", "a", 1), (3, "\n", "en", "b", 1)]
    assert sorted(map(tuple, divergence.audit(table(spark, rows)).collect())) == brute_audit(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_sketch_never_misses(spark):
    """With far more terms than cells, no term of ten documents is discarded; with enough cells, most others are."""
    rows = [(i, " ".join(f"{'abcdefghij'[j % 10]}{chr(0x4E00 + (i * j) % 3000)}" for j in range(40)), "en", "s", 0) for i in range(400)]
    counted = divergence.tally(table(spark, rows).select("lang", "source", "text")).cache()
    truth = Counter(t for r in rows for t in set(r[1].split()))
    for width, keeps in ((256, len(truth)), (1 << 22, 1.2 * sum(n >= 10 for n in truth.values()))):
        bits = divergence.sketch(counted, 10, 4, max(width, divergence.BITS))
        assert bits.any()
        left = {r.term for r in divergence.possible(counted, 10, width=width).select("term").distinct().collect()}
        assert {t for t, n in truth.items() if n >= 10} <= left and len(left) <= keeps
    counted.unpersist()


def test_shares_are_exact(spark):
    numbers = [(0, 0, 1), (5, 7, 3), (10**13, 3 * 10**13, 10**7), (9 * 10**17, 9 * 10**17 + 5, 2), (1, 10**18, 10**9)]
    df = spark.createDataFrame(numbers, "n long, total long, v long")
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in numbers]


# --- 13 -------------------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(i, text, lang, source, n):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    def climb(nodes):
        """The top, and for each node the steps (left, right) to it."""
        paths, level = [[] for _ in nodes], [(h, [k]) for k, h in enumerate(nodes)]
        while len(level) > 1:
            up = []
            for i in range(0, len(level), 3):
                run = level[i : i + 3]
                for j, (_, below) in enumerate(run):
                    for k in below:
                        paths[k].append(([h for h, _ in run[:j]], [h for h, _ in run[j + 1 :]]))
                up.append((H(*[h for h, _ in run]), [k for _, b in run for k in b]))
            level = up
        return level[0][0], paths

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, below = [], []
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        top, paths = climb([x[2] for x in by[s]])
        tops.append(top)
        below.append(paths)
    root, above = climb(tops)
    out = []
    for s, top, paths, path in zip(order, tops, below, above, strict=True):
        for (_, _, mine, r), own in zip(by[s], paths, strict=True):
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            h = leaf(r[0], text, *r[2:])
            for left, right in own + path:
                h = H(*left, h, *right)
            out.append((r[0], mine, top, root, H(*[x for a, b in own + path for x in a + b]), h, h == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n, sources", [(300, ("a", "b", "é", "z", "", None)), (40, tuple("abcdefghijklmnopqrstuvwxyz")), (9, ("a",))])
def test_manifest(spark, n, sources):
    rows = odd(n, n, sources)
    got = manifest.manifest(table(spark, rows)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a\nb", "en", None, 3)], [(1, None, None, "x", None), (1, None, None, "y", None)]])
def test_manifest_of_few(spark, rows):
    got = manifest.manifest(table(spark, rows)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == (brute_manifest(rows) if rows else [])


def test_registered_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = registry.op13_manifest(spark, SF).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(docs)
    got = registry.op12_divergence(spark, SF).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute_audit(docs)
