"""Rows that share an id, with equal and with unlike texts, against brute force: many small tables of their own words in one."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import minhash, ranks, suffixes, windows

from .test_operators import brute_classes

COLUMNS = "doc_id long, text string"


def tables(make, n, ids=5):
    """Rows of n small tables, ids of table k from 100 k: (id, text)."""
    rng, out = random.Random(n), []
    for k in range(n):
        rows = []
        for _ in range(rng.randint(2, 8)):
            again = rows and rng.random() < 0.4
            text = rng.choice(rows)[1] if again else make(rng, k)
            rows.append((100 * k + rng.randint(0, ids), text))
        out += rows + ([rng.choice(rows)] if rng.random() < 0.3 else [])
    rng.shuffle(out)
    return out


def digest(kept):
    return hashlib.sha256(kept).hexdigest()


def brute_words(rows, window):
    """Windows that a document with a smaller id has, by id: rows that share one don't count for one another."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, k), k)
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out.append((k, len(w), len(gone), digest(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return sorted(out)


@pytest.mark.parametrize("most", [windows.MOST, 1])
def test_word_windows(spark, most):
    def make(rng, k):
        return rng.choice([None, "", " ".join(f"t{k}{rng.choice('abc')}" for _ in range(rng.randint(0, 14)))])

    rows = tables(make, 400)
    got = windows.remove_repeats(spark.createDataFrame(rows, COLUMNS), window=4, seed=2, most=most, digest=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, 4)


def test_unique_texts_stay(spark):
    w = lambda a: " ".join(f"w{i}" for i in range(a, a + 20))
    df = spark.createDataFrame([(1, w(0)), (2, w(0)), (2, w(100))], COLUMNS)
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in windows.remove_repeats(df).collect()) == [(1, 0, w(0)), (2, 0, w(100)), (2, 20, "")]
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(600)) for _ in range(2))
    got = suffixes.remove_repeats(spark.createDataFrame([(1, a), (2, a), (2, b)], COLUMNS))
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in got.collect()) == [(1, 600, ""), (2, 0, b), (2, 600, "")]
    x, y = w(0), w(100)
    df = spark.createDataFrame([(1, x, "p"), (2, x, "q"), (2, y, "r")], "doc_id long, text string, own string")
    assert sorted((r.doc_id, r.class_id, r.kept) for r in minhash.classes(df).collect()) == [(1, 1, True), (2, 1, False), (2, 2, True)]
    assert sorted(map(tuple, minhash.first_of_each(df).collect())) == [(1, x, "p"), (2, y, "r")]


@pytest.mark.parametrize("most", [1000, 2])
def test_suffixes(spark, most):
    def make(rng, k):
        return rng.choice([None, "", "".join(rng.choice(f"{chr(0x4E00 + k)}ab") for _ in range(rng.randint(0, 60)))])

    rows, length = tables(make, 150), 12
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    want = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = {j for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1 for j in range(i, i + length)}
        spans = sum(1 for j in gone if j - 1 not in gone)
        want.append((k, len(d), len(gone), spans, digest(bytes(x for i, x in enumerate(d) if i not in gone))))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, COLUMNS), length=length, most=most, digest=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_minhash(spark):
    def make(rng, k):
        words = [f"t{k}x{i}" for i in range(40)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
        return " ".join(words if rng.random() < 0.7 else reversed(words))

    rows = sorted(tables(make, 120))
    by = defaultdict(list)
    for r in rows:
        by[r[0] // 100].append(r)
    want = sorted((mine[i][0], mine[c][0]) for mine in by.values() for i, c in enumerate(brute_classes([t for _, t in mine])))
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted((r.doc_id, r.class_id) for r in minhash.classes(df).collect()) == want
    left = minhash.first_of_each(df).collect()
    groups = sum(len(set(brute_classes([t for _, t in mine]))) for mine in by.values())
    assert {(r.doc_id, r.text) for r in left} <= set(rows) and len({(r.doc_id, r.text) for r in left}) == groups


def test_keys(spark):
    rows = [(5, "a"), (5, "b"), (5, "b"), (1, "a"), (9, None), (9, ""), (None, "x"), (-3, "y")]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("own", F.lit("clash"))
    named, keys, shift = ranks.own_ids(df)
    got = [(r.doc_id, r.text) for r in named.collect()]
    key = {k: i for k, i in keys.collect()}
    assert sorted(((key.get(k), t) for k, t in got), key=repr) == sorted(rows, key=repr) and named.columns == df.columns
    assert len(key) == 6 and sorted(key, key=lambda k: (key[k], k)) == sorted(key)
    assert all((a >> shift == b >> shift) == (key[a] == key[b]) for a in key for b in key)
    assert ranks.own_ids(df.where("doc_id != 5 and doc_id != 9")) is None and ranks.own_ids(df.where("text = 'b'")) is None and ranks.own_ids(df.limit(0)) is None


def test_pipeline_keeps_unique_texts(spark, tmp_path):
    """No text goes for another that shares its id."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", *[f"w{i}" for i in range(300)]]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    first = text()
    rows = [(1, first), (2, first), (2, text()), (3, text()), (3, text()), (4, text())]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3, 3, 4]
