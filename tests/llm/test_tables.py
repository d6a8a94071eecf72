"""Every registered query of the corpus operators on whole tables, against brute force over the same rows."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import fingerprints, language, minhash, packing, registry

from .test_operators import brute_classes, brute_links, brute_words

SF = "/root/testdata/sf0.01"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return sorted(rows("documents"), key=lambda r: r["doc_id"])


def collected(spark, name, key="doc_id"):
    return {r[key]: r for r in registry.QUERIES[name](spark, SF).collect()}


def test_op1(spark):
    got = registry.op1_embedding_dedup(spark, SF).collect()
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got) == brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in rows("embeddings")])


def test_op2(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = collected(spark, "op2_sentencepiece")
    for d in documents:
        ids, r = library.encode(d["text"] or ""), got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_op3(spark, documents):
    got = collected(spark, "op3_minhash_dedup")
    want = [documents[i]["doc_id"] for i in brute_classes([d["text"] for d in documents])]
    assert [got[d["doc_id"]].class_id for d in documents] == want


def test_op5(spark):
    pages = rows("pages")
    data = {r["page_id"]: (r["html"] or "").encode() for r in pages}
    first = {}
    for k in sorted(data):
        first.setdefault(data[k], k)
    got = collected(spark, "op5_warc", "page_id")
    assert set(got) == set(data)
    for k, x in data.items():
        other = first[x]
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode())
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if other == k else ("revisit", other))


def test_op6_against_exact_sets(spark, documents):
    """The same learning and counting with sets of n-grams where the operator has filters."""
    counts, chosen = {}, {}
    for d in documents:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2:
            h = xxhash.xxh64_intdigest(struct.pack("<q", d["doc_id"]), 42)
            chosen.setdefault(d["lang"], []).append((h - (1 << 64) if h >> 63 else h, d["doc_id"], d["text"] or ""))
    for name, found in chosen.items():  # the 400 rows of the smallest hash of their id
        counts[name] = [np.unique(language.grams(t)[0]) for *_, t in sorted(found)[:400]]
    names, sets = sorted(counts), {}
    for name in names:
        found, n = np.unique(np.concatenate(counts[name]), return_counts=True)
        sets[name] = found[np.lexsort((found.view(np.int64), -n))][:60_000]
    got = collected(spark, "op6_language_id")
    for d in documents:
        hashes, _ = language.grams(d["text"] or "")
        r = got[d["doc_id"]]
        if not len(hashes):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = np.array([np.isin(hashes, sets[n]).mean() for n in names])
        best, second = np.sort(share)[::-1][:2]
        assert r.lang_pred == names[int(np.argmax(share))] or best - second < 0.005
        assert abs(r.score - (best - second)) < 0.02


def test_op7(spark, documents):
    """All strings of 400 bytes of the corpus, by 128-bit hashes."""
    data = [(d["text"] or "").encode() for d in documents]
    names = [[hashlib.blake2b(x[i : i + 400], digest_size=16).digest() for i in range(len(x) - 399)] for x in data]
    seen = Counter(h for x in names for h in x)
    got = collected(spark, "op7_suffix_dedup")
    lost = 0
    for d, x, mine in zip(documents, data, names, strict=True):
        gone = np.zeros(len(x) + 1, dtype=np.int64)
        for i, h in enumerate(mine):
            if seen[h] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int(np.sum(np.diff(np.concatenate(([0], mask.astype(int)))) == 1))
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(x), int(mask.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(bytes(np.frombuffer(x, dtype=np.uint8)[~mask])).hexdigest()
        lost += spans > 0
    assert lost > 20


def test_op8(spark, documents):
    got = collected(spark, "op8_substring_dedup")
    want = brute_words([d["text"] for d in documents])
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in (got[d["doc_id"]] for d in documents)] == want and sum(w[1] > 0 for w in want) > 20


def test_op9(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got, sequences = {}, {}
    for r in registry.op9_packing(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    total = 0
    for d in documents:
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        at = 0
        for piece, r in enumerate(sorted(got[d["doc_id"]], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (piece, at, zlib.crc32(ids[at : at + r.length].tobytes())) and (r.length == 1024 or piece == 0)
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or piece == 0)
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:i]) for i in range(len(found))] and sum(r.length for r in found) <= packing.CAPACITY
    least = -(-total // packing.CAPACITY)
    assert least <= len(sequences) <= 1.01 * least + 1


# --- 10: a plain one-permutation MinHash with Spark's hash functions ------------------------------------------------


def _murmur(words: list[int], length: int, seed: int) -> int:
    h = seed & 0xFFFFFFFF
    for k in words:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= length
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h


def _hash(*values: int | str | tuple[int]) -> int:
    h = 42
    for v in values:
        if isinstance(v, tuple):
            h = _murmur([v[0] & 0xFFFFFFFF, v[0] >> 32 & 0xFFFFFFFF], 8, h)
        elif isinstance(v, str):
            data = v.encode()
            assert len(data) % 4 == 0
            h = _murmur([int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)], len(data), h)
        else:
            h = _murmur([v & 0xFFFFFFFF], 4, h) if -(2**31) <= v < 2**31 else _murmur([v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF], 8, h)
    return h - (1 << 32) if h >> 31 else h


def _as_long(v: int) -> tuple[int]:
    """A whole number that is hashed as eight bytes, however small."""
    return (v,)


def plain_fingerprint(text: str) -> str:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return "0" * 256
    rest = 63 - fingerprints.BIN_BITS
    least: dict[int, int] = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        h >>= 1
        least[h >> rest] = min(h, least.get(h >> rest, h))
    out = []
    for b in range(fingerprints.BINS):
        if b not in least:
            tries = [_hash(b, t) & (fingerprints.BINS - 1) for t in range(1, fingerprints.PROBES + 1)]
            full = [j for j in tries if j in least]
            late = min(least, key=lambda j: (_hash(b, _as_long(j), "late"), least[j])) if not full else None
            out.append(least[full[0] if full else late] & 15)
        else:
            out.append(least[b] & 15)
    return "".join(f"{x:x}" for x in out)


def test_op10(spark, documents):
    got = collected(spark, "op10_fingerprints")
    for i, d in enumerate(documents):
        text, following, r = d["text"] or "", documents[(i + 1) % len(documents)]["text"] or "", got[d["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for t, mine in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert mine == plain_fingerprint(t)
        for other, near in ((r.edited_fingerprint, r.near_edited), (got[documents[(i + 1) % len(documents)]["doc_id"]].fingerprint, r.near_next)):
            empty = [x == "0" * 256 for x in (r.fingerprint, other)]
            agree = sum(a == b for a, b in zip(r.fingerprint, other, strict=True)) / 256
            assert near == pytest.approx(1.0 if all(empty) else 0.0 if any(empty) else min(1.0, max(0.0, (agree - 1 / 16) / (1 - 1 / 16))))


# --- The pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES[:-1]:
        done = stage(spark, d, str(tmp_path))
        assert done.columns == d.columns and done.count() == 0
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline as p

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    more = d.withColumns({c: F.lit("clash") for c in ("bucket", "kept", "n_removed", "rep", "bands", "text_key", "score", "lang_pred", "component")})
    one = p.language_stage(spark, more, "")
    assert set(d.columns) <= set(one.columns)
    two = p.near_dedup_stage(spark, one, "")
    assert sorted(two.columns) == sorted(one.columns)
    three = p.substring_dedup_stage(spark, two, "")
    assert three.columns == d.columns
    plain = p.substring_dedup_stage(spark, p.near_dedup_stage(spark, p.language_stage(spark, d, ""), ""), "")
    assert sorted(map(tuple, three.collect())) == sorted(map(tuple, plain.collect()))
    assert minhash.classes(more).count() == 60
