"""Each operator against brute force or an exact round trip, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import common, fingerprints, graph, language, minhash, packing, pieces, registry, shingles, suffixes, urls, vectors, warc, windows

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a b c", "▁ x ▁▁", "é日😀 \t\n x", "<s> <0x0A> </s>", "  two  spaces ", "word " * 3000, "<|endoftext|> x", "x" * 5000, "a b\x85c"]


def docs(spark, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{k} string" for k in more]]))


def prose(seed, n, words=60, vocabulary=400):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]


# --- 1 --------------------------------------------------------------------------------------------------------------


def brute_links(rows):
    """n_links and component of (id, vector, label) rows."""
    good = {}
    for k, (i, v, g) in enumerate(rows):
        if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=float)
    links, part = {k: 0 for k in range(len(rows))}, {k: k for k in range(len(rows))}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98:
                links[a] += 1
                links[b] += 1
                part[root(b)] = root(a)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min([x for x in (least.get(root(k)), rows[k][0]) if x is not None], default=None)
    return sorted((repr((rows[k][0], links[k], least[root(k)])) for k in range(len(rows))))


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(220):
        base = rng.normal(size=8)
        rows.append((i, base.tolist(), i % 3))
        for j in range(i % 4):
            rows.append((1000 + 10 * i + j, (base * (j + 1) + rng.normal(size=8) * 0.08 * j).tolist(), i % 3))
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 8, 1), (5003, [1.0, None] * 4, 1), (5004, [float("nan")] * 8, 1), (5005, [float("inf")] * 8, 1), (5006, rows[0][1], None), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = vectors.link(df, block=block, recall=1.0).collect()
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_index_visits_nearest_first_and_misses_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vectors.Index(x, 6, 0.98, 1.0, np.zeros(300))
    for v in x[:40]:
        near = v + rng.normal(size=16) * 0.03
        near /= np.linalg.norm(near)
        if near @ v >= 0.98:
            bounds, home = index.bounds(v), index.home(index.bounds(near))
            order = index.visit(bounds)
            assert home[0] * len(bounds[1]) + home[1] in order
            sums = [bounds[0][c // len(bounds[1])] ** 2 + bounds[1][c % len(bounds[1])] ** 2 for c in order]
            assert sums == sorted(sums)


def test_a_hot_group_does_not_hide_other_pairs():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 16))
    pairs = np.concatenate([base, base + rng.normal(size=(150, 16)) * 0.15])
    hot = rng.normal(size=16) + rng.normal(size=(250, 16)) * 1e-4  # 31,125 pairs that need no reach
    pairs, hot = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (pairs, hot))
    groups = np.array([*range(1, 151)] * 2)
    index = vectors.Index(pairs, 12, 0.98, 1.0, groups)
    apart = index._needed(pairs, groups, 0.98, 1.0)
    assert apart > 0.1 and index._needed(np.concatenate([hot, pairs]), np.concatenate([np.zeros(250), groups]), 0.98, 1.0) >= apart


def test_no_vectors(spark):
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            part[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for chunk in (graph.CHUNK, 0):  # in one task, and in rounds
        found = list(map(tuple, graph.components(df, chunk).collect()))
        assert dict(found) == {x: root(x) for x in part if any(x in e and e[0] != e[1] for e in edges)} and len(found) == len(dict(found))
        assert graph.components(df.limit(0), chunk).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_pieces(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = docs(spark, ODD, decoded=ODD).withColumn("ids", F.lit(1))
    got = {r.doc_id: r for r in pieces.encode(df, MODEL).collect()}
    digest = {r.doc_id: r for r in pieces.encode(df, MODEL, digest=True).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "")
        assert list(got[i].ids) == ids and got[i].decoded == library.decode(ids)
        assert digest[i].n_tokens == len(ids) and digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_at_random():
    m = pieces.Merger(open(MODEL, "rb").read())
    rng = random.Random(1)
    parts = ["a", "t", "he", " ", "  ", "▁", "\n", "\0", "é", "日", "<s>", "<0x0A>", "\xa0", "😀", " the", "\t", "�", "ing"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        w = m.words(t)
        m.learn(set(w))
        ids = [int(i) for x in w for i in m.ids_of[x].split(",")]
        assert ids == m.library.encode(t) and m.text(w) == m.library.decode(ids) == m.decode(ids)[1:]


# --- 3 --------------------------------------------------------------------------------------------------------------


def brute_classes(texts, least=0.8):
    sets = [set(zip(*[w[i:] for i in range(min(5, len(w)))])) if w else set() for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]]
    part = list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(texts))]


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_minhash_classes(spark):
    rng = random.Random(2)
    base = prose(7, 30, 120)
    texts = base + [edited(t, rng, k) for t in base for k in (1, 2, 4, 8)] + base[:3] + ODD + [edited(base[0], rng, rng.randint(1, 9)) for _ in range(60)]
    df = docs(spark, texts, class_id=texts)
    got = {r.doc_id: r for r in minhash.classes(df).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert [got[i].kept for i in range(len(texts))] == [i == c for i, c in enumerate(want)]
    left = minhash.first_of_each(df)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want)) and set(left.columns) == set(df.columns)


@pytest.mark.parametrize("crowd", [4, 256])
def test_minhash_of_many_unlike_halves(spark, crowd):
    """Documents that share half of their shingles meet in large buckets; those that are alike are found among them."""
    rng = random.Random(21)
    common_half = " ".join(prose(31, 1, 80, 5000))
    halves = [f"{common_half} {own}" for own in prose(32, 240, 80, 5000)]
    texts = halves + [edited(t, rng, 2) for t in halves[::3]]
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(spark, texts), crowd=crowd).collect()}
    want = brute_classes(texts)
    assert sum(got[i] == want[i] for i in range(len(texts))) >= 0.99 * len(texts)


def test_large_groups_are_dealt_by_bands(spark):
    rng = random.Random(4)
    signature = [[rng.randrange(9) * 1000 + i for i in range(minhash.BANDS)] for _ in range(400)]
    alike = [(k, 400 + k) for k in range(60)]  # a third of the bands in common with another, as documents that are alike have
    signature += [[x if rng.random() < 1 / 3 else 10**6 + 100 * k + i for i, x in enumerate(signature[k])] for k, _ in alike]
    texts = spark.createDataFrame([(i, s) for i, s in enumerate(signature)], "rep long, bands array<long>")
    groups = texts.select(F.lit(7).cast("long").alias("key"), F.col("rep").alias("a"), F.col("rep").alias("component"))
    met = minhash._dealt(groups, texts, 16).distinct().collect()
    assert len(met) < 460 * 460 / 4 and {(r.a, r.b) for r in met} <= {(a, b) for b in range(460) for a in range(b)}
    assert len(set(alike) & {(r.a, r.b) for r in met}) >= 58


@pytest.mark.parametrize(("crowd", "weighted"), [(2, False), (2, True), (60, False)])
def test_large_groups_lose_no_link(spark, crowd, weighted):
    """Pairs just at the similarity sought, all with one leader: bands alone, however many, leave some of them apart."""
    rng = random.Random(77)
    n, whole = 60, rng.sample(range(10**6), 600)
    own = [rng.sample(whole, 100) for _ in range(n)]
    # The second document of a pair has 90 of its 100 shingles and 12 others of the leader: 90 / 112 = 0.8036.
    rows = own + [[*x[:90], *rng.sample(sorted({*whole} - {*x}), 12)] for x in own] + [whole]
    packed = [np.sort(np.array(r, dtype="<u8")) for r in rows]
    weights = [np.ones(len(r)) for r in packed]
    sketch = minhash.bands(minhash.signatures(list(zip(packed, weights, strict=True)))).view(np.int64).tolist()
    blob = lambda r: (np.stack((r, np.ones(len(r), dtype="<u8")), axis=1) if weighted else r).tobytes()
    sets = spark.createDataFrame([(i, bytearray(blob(r))) for i, r in enumerate(packed)], "doc_id long, shingles binary")
    texts = spark.createDataFrame(list(enumerate(sketch)), "rep long, bands array<long>")
    asked = spark.createDataFrame([(i, 2 * n, 1) for i in range(2 * n)], "a long, b long, degree long")
    first = common.materialize(minhash._verify(asked, sets, weighted, 0.8), "pairs")
    joined = spark.createDataFrame([], "node long, component long")
    got = {r.node: r.component for r in minhash._open_links(first, joined, sets, texts, weighted, 0.8, crowd).collect()}
    assert all(got.get(n + i) == i and got.get(i) == i for i in range(n)) and len(got) == 2 * n


def test_minhash_with_clashing_columns(spark):
    texts = prose(41, 6, 30)
    df = docs(spark, texts + texts[:2], text_key=texts + texts[:2], bands=texts + texts[:2], kept=texts + texts[:2])
    assert sorted((r.doc_id, r.class_id) for r in minhash.classes(df).collect()) == [(i, i) for i in range(6)] + [(6, 0), (7, 1)]
    left = minhash.first_of_each(df)
    assert left.count() == 6 and sorted(left.columns) == sorted(df.columns)


def test_minhash_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in minhash.classes(df).where("doc_id is not null").collect()) == [(1, 1), (1, 1)]
    assert minhash.classes(df).where("doc_id is null and class_id is null").count() == 1
    assert minhash.classes(df.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(40):
        e = common.mix(np.unique(rng.integers(0, 2**62, 200).astype(np.uint64)))
        wa, wb = rng.integers(0, 6, len(e)).astype(float), rng.integers(0, 6, len(e)).astype(float)
        sig = minhash.signatures([(e[w > 0], w[w > 0]) for w in (wa, wb)])
        errors.append((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_weighted_classes(spark):
    a = "p q r s t " * 30
    df = docs(spark, [a + "x y z u v", a + "x y z u w", "p q r s t"])
    assert [r.class_id for r in minhash.classes(df, weighted=True).orderBy("doc_id").collect()] == [0, 0, 2]


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    entries = spark.createDataFrame(
        [("example.org", "spam", "add", 10), ("example.org", "spam", "remove", 20), ("a.example.org", "adult", "add", 15), ("example.org", "spam", "add", 30), ("example.org", "spam", "add", 30), ("b.org", "x", "add", 5), ("b.org", "x", "remove", 5), (None, "x", "add", 1)],
        "key string, category string, action string, day long",
    )
    asked = [(1, "https://A.Example.org:80/x", 12), (2, "http://u@a.example.org./", 16), (3, "http://example.org", 25), (4, "http://example.org/", 30), (5, "http://b.org", 6), (6, None, 3), (7, "nonsense", 3), (8, "http://notexample.org/", 12), (1, "https://A.Example.org:80/x", 12), (9, "http://example.org", None)]
    df = spark.createDataFrame(asked, "page_id long, url string, fetch_day long").withColumn("key", F.lit("clash"))
    got = sorted((r.page_id, r.blocked, r.matched_key, r.valid_from) for r in urls.filter_captures(df, entries).collect())
    assert got == [(1, True, "example.org", 10), (1, True, "example.org", 10), (2, True, "a.example.org", 15), (3, False, None, None), (4, True, "example.org", 30), (5, False, None, None), (6, False, None, None), (7, False, None, None), (8, False, None, None), (9, False, None, None)]
    assert urls.filter_captures(df.limit(0), entries).count() == 0


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "<p>é日</p>", "WARC/1.1\r\n\r\n0\r\n\r\n", "<p>é日</p>", "x" * 300, "é" * 400, "x" * 300, "", "<p>é日</p>"]
    rows = [(i, f"http://h/{i} \r\nX: y" if i % 3 else None, t) for i, t in enumerate(html)]
    rows += [rows[6], rows[6]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = warc.write(df, str(tmp_path / "w"), segment=150, chunk=64)
    back = warc.read(spark, path).collect()
    assert len(back) == len(rows) and all(r.ok for r in back)
    for r in back:
        data = (html[r.page_id] or "").encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.record_type == "revisit" or bytes(r.payload) == data
    out = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df, segment=150).collect()}
    assert out[0] == ("response", None, 0) and out[1] == ("revisit", 0, 0) and out[4] == ("revisit", 2, 12) and out[7] == ("revisit", 5, 300) and out[6] == ("response", None, 800)
    assert {warc.round_trip(df, least_bytes=13).where(f"page_id = {i}").head().record_type for i in (1, 4)} == {"response"}


def test_warc_segments_are_verified(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string")
    lines = [r.record for r in warc.records(df, segment=200).collect()]
    assert len(lines) > 2
    for i, broken in enumerate((lines[:1] + lines[2:], lines[:-1], lines[1:])):
        spark.createDataFrame([(x,) for x in broken], "record string").coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(str(tmp_path / str(i)))
        rows = warc.read(spark, str(tmp_path / str(i))).collect()
        assert len(rows) == 1 and not rows[0].ok and rows[0].payload is None


def test_each_record_is_a_gzip_member(spark, tmp_path):
    """Other readers see members one after another, of which every other one is a record; files are bounded by bytes."""
    texts = ["<p>é</p>" * 40, "x" * 1000, ""]
    path = warc.write(spark.createDataFrame(enumerate(texts), "page_id long, html string").withColumn("url", F.lit("http://h/")).coalesce(1), str(tmp_path / "w"), segment=300)
    files = sorted((tmp_path / "w").glob("part-*"))
    data = b"".join(f.read_bytes() for f in files)
    members = []
    while data:
        d = zlib.decompressobj(31)
        members.append(d.decompress(data))
        data = d.unused_data
    records = [m for m in members if m]
    assert len(members) == 2 * len(records) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in records)
    assert b"".join(warc.inflate(b"".join(f.read_bytes() for f in files), 7)) == b"".join(records)
    assert [h for h, _ in warc.parse(records)] == [h for h, _ in warc.parse([bytes([x]) for x in b"".join(records)])]
    for broken in (files[0].read_bytes()[:-9], files[0].read_bytes()[:30]):
        with pytest.raises(ValueError, match="cut short"):
            list(warc.parse(warc.inflate(broken)))
    assert warc.read(spark, path).where("ok").count() == 3


def test_chunked_framing():
    assert warc.dechunk(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n") == b"abcde"
    for bad in (b"3\r\nab", b"zz\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b""):
        assert warc.dechunk(bad) is None


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_language(spark, sf):
    from mnemospark.llm.registry import op6_language_id

    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op6_language_id(spark, "/root/testdata/sf0.01").join(docs_, "doc_id").toPandas()
    for held in (True, False):
        part = found[found.held_out == held]
        assert (part.lang_pred == part.lang).mean() > 0.97
    assert all(bool(zlib.crc32(str(k).encode()) % 4 == 2) == h for k, h in zip(found.doc_id, found.held_out, strict=True))
    assert found.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    learned = [("the cat and the dog went over there", "en"), ("der hund und die katze gingen dort", "de")] * 5 + [(t, None) for t in ODD] + [("1234 !!", "en"), ("the dog", None), ("die katze", None)]
    df = docs(spark, [t for t, _ in learned], lang=[x for _, x in learned]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert got[len(learned) - 2].lang_pred == "en" and got[len(learned) - 1].lang_pred == "de"
    for i, (t, _) in enumerate(learned):
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    none = language.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"} and language.identify(df.limit(0)).count() == 0


def test_language_of_a_single_row(spark):
    words = {name: [f"{a}{x}{b}" for x in "aeiou" for a in letters for b in letters] for name, letters in {"a": "bcd", "b": "fgh", "c": "klm", "d": "prs", "z": "vwx"}.items()}
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(words[name], k=30)), name) for name in "abcd" for _ in range(100)] + [(" ".join(words["z"]), "z")]
    df = docs(spark, [t for t, _ in rows], lang=[x for _, x in rows])
    for rare in (df, df.where("doc_id % 100 < 5")):  # 401 and 21 rows: one rule at every size
        fitted = language.learn(rare)
        assert fitted.names == ["a", "b", "c", "d", "z"]
        assert [fitted.predict(" ".join(rng.choices(words[name], k=20)))[0] for name in "abcdz"] == ["a", "b", "c", "d", "z"]


def test_filter_counts_are_corrected():
    f = language.Filter(["a", "b"], [(int(x), int(x) % 2) for x in np.random.default_rng(1).integers(-(2**62), 2**62, 3000)], 12)
    assert f.chance.shape == (2,) and (f.chance > 0.05).all()
    many = language.Filter([f"l{i:03}" for i in range(130)], [(i * 7919, i) for i in range(130)], 16)
    assert many.cells.shape == (1 << 16, 3)


# --- 7 --------------------------------------------------------------------------------------------------------------


def brute_bytes(texts, length):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~mask])
        spans = int(np.sum(np.diff(np.concatenate(([0], mask.astype(int)))) == 1))
        out.append((len(d), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "most"), [(40, 1000), (40, 1), (12, 3)])
def test_suffix_dedup(spark, length, most):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 300))) for _ in range(25)]
    shared = "".join(rng.choice("xyz") for _ in range(90))
    texts = base + [b[:60] + shared[rng.randint(0, 30) :] + b[60:] for b in base] + base[:2] + ["a" * 200, "ab" * 90, "a" * 39, "a" * 41] + ODD[:9]
    df = docs(spark, texts, n_bytes=texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, length=length, most=most, digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, length)


def test_suffix_dedup_gives_the_kept_text(spark, tmp_path):
    """Passages of over 50 words that repeat across documents are gone from the text, what is clean is the text itself."""
    rng = random.Random(20)
    passage = lambda: " ".join("".join(rng.choice("abcdefgé") for _ in range(9)) for _ in range(60))
    clean, planted = [passage() for _ in range(6)], passage()
    texts = [*clean, *(f"{passage()} {i}\n{planted}\n{i} {passage()}" for i in range(4)), None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.op7_suffix_dedup(spark, str(tmp_path))
    assert found.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {r.doc_id: r for r in found.collect()}
    for i, (t, (n, gone, spans, digest)) in enumerate(zip(texts, brute_bytes(texts, 400), strict=True)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, gone, spans, digest)
        assert hashlib.sha256(got[i].text.encode()).hexdigest() == digest and planted not in got[i].text
        assert (got[i].text == (t or "")) == (not 6 <= i < 10) == (gone == 0)


def test_suffix_dedup_halves_of_characters(spark):
    """Cuts between the bytes of a character: the digest is of the bytes, the text has the replacement character."""
    texts = ["\u00e9" + "x" * 12, "\u00a9" + "x" * 12 + "z", "\u4e00\u4e01\u4e02\u4e03\u4e04", "\u5e00\u4e01\u4e02\u4e03\u4e04"]
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs(spark, texts), length=12, digest=True).collect()}
    for i, want in enumerate(brute_bytes(texts, 12)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    data = [(t.encode(), got[i].n_removed) for i, t in enumerate(texts)]
    assert [n for _, n in data] == [13, 13, 14, 14]
    assert [got[i].kept for i in range(4)] == ["\ufffd", "\ufffdz", "\ufffd", "\ufffd"]


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(150):
        n, letters = rng.randint(1, 60), rng.choice([1, 2, 3, 200])
        t = np.array([rng.randint(1, letters) for _ in range(n)], dtype=np.int16)
        order = suffixes.suffix_array(t, 100)
        assert order.tolist() == sorted(range(n), key=lambda i: tuple(t[i:]))
        wanted = np.array([rng.random() < 0.3 for _ in range(n)])
        some = suffixes.suffix_array(t, 100, wanted).tolist()
        assert set(np.flatnonzero(wanted).tolist()) <= set(some) and some == [i for i in order.tolist() if i in set(some)]


def test_suffix_dedup_without_rows_or_ids(spark):
    assert suffixes.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "abc" * 300), (1, "abc" * 5)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixes.remove_repeats(df).collect()) == [0, 0]


# --- 8 --------------------------------------------------------------------------------------------------------------


def brute_words(texts, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = []
    for k, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [windows.MOST, 1])
def test_word_windows(spark, most):
    rng = random.Random(6)
    base = prose(1, 40, 80)
    texts = base + [edited(b, rng, 3) for b in base] + base[:3] + [" ".join(base[0].split()[5:40] + base[1].split()[:20]), base[2].replace(" ", "\n\t ")] + ODD + ["same " * 50, "same " * 60]
    # A short phrase amid different words: its seeds have a context for each document, of which none is a window.
    texts += [f"{a} the same seven words stand in here {b}" for a, b in zip(prose(8, 30, 9), prose(9, 30, 9), strict=True)]
    df = docs(spark, texts, kept=texts).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in windows.remove_repeats(df, most=most, digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts)


def test_word_windows_of_other_sizes(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for window, seed in ((4, 2), (7, 3), (5, 5)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in windows.remove_repeats(docs(spark, texts), window=window, seed=seed, digest=True).collect()}
        assert [got[i] for i in range(len(texts))] == brute_words(texts, window)


def test_word_windows_carry_columns_of_any_name(spark):
    base = prose(1, 10, 40)
    texts = base + base[:4] + ODD
    clash = {"bucket": texts, "n_removed": texts, "rows": texts, "runs": texts}
    df = docs(spark, texts, **clash)
    carried = windows.remove_repeats(df.drop("n_removed"), carry=["bucket", "rows", "runs"])
    assert carried.columns == ["doc_id", "bucket", "rows", "runs", "n_words", "n_removed", "kept"]
    want = brute_words(texts)
    for r in carried.collect():
        assert r.bucket == r.rows == r.runs == texts[r.doc_id] and r.n_removed == want[r.doc_id][1]
        assert r.n_removed or r.kept == texts[r.doc_id]


def test_words_in_slices(monkeypatch, spark):
    monkeypatch.setattr(shingles, "CHUNK", 64)
    parts = shingles.words(" ".join(prose(3, 1, 500)))
    monkeypatch.setattr(shingles, "CHUNK", 1 << 20)
    whole = shingles.window_hashes(parts, 5)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert (shingles.window_hashes(parts, 5) == whole).all()
    v = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    assert [int(x) for x in shingles.sliding_argmin(v, 9)] == [i + int(np.argmin(v[i : i + 9] >> np.uint64(24))) for i in range(292)]


def test_no_windows(spark):
    assert windows.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "w " * 40), (1, "w " * 40), (1, "w " * 40)], "doc_id long, text string")
    assert [r.n_removed for r in windows.remove_repeats(df).collect()] == [0, 0, 0]


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = ODD + prose(2, 40, 30) + ["long word " * 1500]
    rows = packing.pack_documents(docs(spark, texts, offset=texts), BPE, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine[:-1]]))
        assert np.frombuffer(b"".join(bytes(r.ids) for r in mine), dtype="<u4").tolist() == ids
        assert all(r.length == 1024 for r in mine[1:]) and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in mine)
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == list(np.cumsum([0] + [r.length for r in found[:-1]])) and sum(r.length for r in found) <= 1024
    assert packing.pack_documents(docs(spark, ["x"]).limit(0), BPE).count() == 0


def test_plans():
    from collections import Counter

    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 64, 1024])
        counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 7, 1000]) for _ in range(rng.randint(0, 50))}
        total = Counter()
        for lengths, n in packing.plan(counts, capacity):
            assert n > 0 and sum(lengths) <= capacity and sum(3 * k > capacity for k in lengths) <= 2
            for k in lengths:
                total[k] += n
        assert total == Counter(counts)
    assert sum(n for _, n in packing.plan({600: 5, 424: 5, 100: 3}, 1024)) == 6


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    texts = ODD + prose(9, 40, 150) + [ODD[8]]
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs(spark, texts, edited=texts)).collect()}
    errors = []
    sets = lambda t: set(zip(*[w[i:] for i in range(min(5, len(w)))])) if (w := re.findall(r"[^\x20\x09-\x0D]+", t)) else set()
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        other = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest()) and len(r.fingerprint) == len(r.edited_fingerprint) == 256
        a, b = sets(t), sets(other)
        if len(a | b) > 50:
            errors.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07
    assert got[8].fingerprint == got[len(texts) - 1].fingerprint and got[0].fingerprint == got[1].fingerprint == "0" * 256
    assert got[0].near_next == 1.0 and got[2].near_next == 0.0
    assert fingerprints.compare_edits(docs(spark, ["x"]).limit(0)).count() == 0


# --- Pipeline and queries -------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language", "near_dedup", "substring_dedup", "packing"]
    one = p.language_stage(spark, d, sf)
    assert one.columns == d.columns and one.count() == d.count()
    two = p.near_dedup_stage(spark, one, sf)
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(brute_classes(texts)))
    three = p.substring_dedup_stage(spark, two, sf)
    assert three.columns == d.columns
    kept = {r.doc_id: r for r in three.collect()}
    rows = two.orderBy("doc_id").collect()
    for r, (n, gone, digest) in zip(rows, brute_words([r.text for r in rows]), strict=True):
        if gone == 0:
            assert kept[r.doc_id].text == r.text and kept[r.doc_id].n_chars == r.n_chars
        elif gone < n:
            assert hashlib.sha256(kept[r.doc_id].text.encode()).hexdigest() == digest
        else:
            assert r.doc_id not in kept
    packed = p.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_pipeline_without_labels(spark, sf, tmp_path):
    import corpus_pipeline as p

    d = docs(spark, ["the cat went", None, "", "12 _ ½ !", "1 é", *ODD]).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    stays = lambda df: sorted(r.doc_id for r in p.language_stage(spark, df, sf).collect())
    assert p.language_stage(spark, d, sf).columns == d.columns
    labelled = d.withColumn("lang", F.when(F.col("doc_id") == 0, "en"))
    assert stays(d) == stays(labelled) and {0, 4} <= set(stays(d)) and not {1, 2} & set(stays(d))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() > 0


def test_registered_queries(spark, sf):
    import __spark_entry__ as e

    names = e.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_url_query_against_sql(spark, sf):
    import duckdb

    from mnemospark.llm.registry import ORACLE_SQL, op4_url_filters

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = con.sql(ORACLE_SQL["op4_url_filters"])
    got = op4_url_filters(spark, sf)
    assert sorted(map(repr, got.select(*sorted(got.columns)).collect())) == sorted(repr(r) for r in spark.createDataFrame(rel.fetchall(), "page_id long, host string, fetch_day long, blocked boolean, matched_key string, category string, valid_from long").select(*sorted(got.columns)).collect())
