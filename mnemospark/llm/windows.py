"""Repeated passages of words: seed and extend.

1. Seeds are winnowed: of the runs of SEED words inside each window of `window` words, the one of the smallest hash is the
   window's anchor, so equal windows have equal anchors at equal places. All windows of one anchor are neighbours; the
   words from the first window's first to the last one's last are the anchor's context.
2. Documents are joined on anchors. Of the copies of one context, those in documents with a larger id than the smallest
   are repeated from end to end; they are told by 128 bits (64 of the seed and 64 of the context). An anchor that has one
   context only needs no further look. The other contexts are asked for from the smallest document of each.
3. The contexts of an anchor are extended from the seed's words, one word at a time to the left and to the right, all
   against all at once: after each step the contexts that are equal so far share a number. Where a left and a right
   extension add up to a window, its contexts repeat one another, and those outside of the smallest document lose it.
   These are the words themselves, not hashes; a step is linear in the number of contexts.
4. Neighbouring windows make the maximal repeats, which are cut from the texts.

An anchor with more than MOST contexts (a short phrase that stands in many documents amid different words) isn't
extended in one task: its windows are dealt by their own hash (128 bits with the seed's), which finds the same ones. A
context that comes again in a pack of texts travels once, that of the smallest id; the others are known to be repeated
and go straight to their documents. So a passage that stands in a third of all rows costs its anchors once for each pack.

Words are what stands between spaces and the characters 9 to 13, unchanged. A null text has none. Rows that share an id
but not the text are documents of their own; neither has the smaller id, so they lose nothing to one another, and each loses
what a document with a smaller id has. Equal rows lose the same. A row without id is neither searched nor changed. Documents
are judged on the input, whatever is removed from the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, ranks, shingles

U64 = np.uint64
WINDOW = 13
SEED = 5
#: Contexts of one anchor that are extended in one task.
MOST = 1 << 14
#: Bytes of text in one pack, and words of one document that are looked at in one go.
PACK = 4 << 20
SLICE = 1 << 20
#: Hashes of seed and context; the text's place in the pack; first window, windows, and where the seed is from the first word.
_ROW = np.dtype([("seed", "<u8"), ("context", "<u8"), ("doc", "<u2"), ("start", "<u4"), ("n", "<u2"), ("off", "<u2")])
#: A run of a document that is known to be repeated.
KNOWN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])
#: What a text is asked for: a context, and whether window by window.
_ASK = np.dtype([("seed", "<u8"), ("context", "<u8"), ("start", "<u4"), ("n", "<u2"), ("off", "<u2"), ("split", "u1")])
_PART = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u2"), ("off", "<u2"), ("size", "<u4")])
_WINDOW = np.dtype([("seed", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("start", "<u4")])


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def anchors(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Seed hash, context hash, first window, windows and the seed's place of each anchor, from the hashes of a text's words."""
    out = []
    for first in range(0, max(0, len(words) - window + 1), SLICE):
        prefix = common.prefix_hash(words[first : first + SLICE + window - 1])
        at = np.arange(len(prefix) - seed)
        seeds = common.span_hash(prefix, at, at + seed)
        chosen = shingles.sliding_argmin(seeds, window - seed + 1)
        s, e = shingles.runs(chosen)
        off = chosen[s] - s
        out.append((seeds[chosen[s]], common.mix(common.span_hash(prefix, s, e + window - 1) + off.astype(np.uint64)), s + first, e - s, off))
    if not out:
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _pack(docs: list[int], texts: list[list[bytes]], window: int, seed: int, buckets: int, shift: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, kind and content: anchors by their seed (0), and windows that repeat others of this pack by document (1)."""
    found = [anchors(shingles.window_hashes(parts, 1), window, seed) for parts in texts]
    rows = np.empty(sum(len(f[0]) for f in found), dtype=_ROW)
    if not len(rows):
        return
    for i, name in enumerate(("seed", "context", "start", "n", "off")):
        rows[name] = np.concatenate([f[i] for f in found])
    owner, ids = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]), np.array(docs, dtype=np.int64)
    rows["doc"] = owner
    order = np.lexsort((ids[owner], rows["context"], rows["seed"]))
    heads = np.flatnonzero(_fresh(rows["seed"][order], rows["context"][order]))
    least = np.repeat(ids[owner][order][heads], np.diff(np.concatenate((heads, [len(rows)]))))
    known = np.empty(len(rows), dtype=bool)
    known[order] = ids[owner][order] >> shift > least >> shift
    sent = rows[~known]
    bucket = (sent["seed"] >> U64(32)) % U64(buckets)
    by = np.argsort(bucket, kind="stable")
    for s, e in zip(*shingles.runs(bucket[by]), strict=True):
        r = sent[by[s:e]]
        used = np.unique(r["doc"])
        r["doc"] = np.searchsorted(used, r["doc"])
        yield int(bucket[by[s]]), 0, np.array([len(used)], dtype="<u4").tobytes() + ids[used].astype("<i8").tobytes() + r.tobytes()
    if known.any():
        doc, start, n = join_runs(ids[owner[known]], rows["start"][known].astype(np.int64), rows["n"][known].astype(np.int64))
        runs = np.empty(len(doc), dtype=KNOWN)
        runs["doc"], runs["start"], runs["n"] = doc, start, n
        bucket = common.mix(doc.astype(np.uint64)) % U64(buckets)
        by = np.argsort(bucket, kind="stable")
        for s, e in zip(*shingles.runs(bucket[by]), strict=True):
            yield int(bucket[by[s]]), 1, runs[by[s:e]].tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
    rows = np.frombuffer(blob, dtype=_ROW, offset=4 + 8 * n)
    return np.frombuffer(blob, dtype="<i8", count=n, offset=4)[rows["doc"]], rows


def _answers(run_doc: np.ndarray, run_start: np.ndarray, run_n: np.ndarray, ask_doc: np.ndarray, asks: np.ndarray) -> pa.Table:
    """doc_id, runs and asks, a row for each document."""
    run_doc, run_start, run_n = join_runs(run_doc, run_start, run_n)
    by = np.argsort(ask_doc, kind="stable")
    ask_doc, asks = ask_doc[by], asks[by]
    ids = np.unique(np.concatenate((run_doc, ask_doc)))
    spans = np.stack((run_start, run_n), axis=1).astype("<u4")
    a, b = np.searchsorted(run_doc, ids), np.searchsorted(run_doc, ids, side="right")
    c, d = np.searchsorted(ask_doc, ids), np.searchsorted(ask_doc, ids, side="right")
    return pa.table({
        "doc_id": pa.array(ids, type=pa.int64()),
        "runs": pa.array([spans[i:j].tobytes() for i, j in zip(a, b, strict=True)], type=pa.binary()),
        "asks": pa.array([asks[i:j].tobytes() for i, j in zip(c, d, strict=True)], type=pa.binary()),
    })


def _judge(blobs: list[bytes], most: int, shift: int) -> pa.Table:
    """What repeats a smaller document's context from end to end, and which contexts must be extended."""
    doc, rows = map(np.concatenate, zip(*map(_unpack, blobs), strict=True))
    order = np.lexsort((rows["start"], doc, rows["context"], rows["seed"]))
    doc, rows = doc[order], rows[order]
    fresh = _fresh(rows["seed"], rows["context"])
    heads = np.flatnonzero(fresh)
    leads = doc >> shift == doc[heads][np.cumsum(fresh) - 1] >> shift
    seed = np.cumsum(_fresh(rows["seed"])) - 1
    contexts = np.bincount(seed[heads])[seed]
    asked = leads & (contexts > 1) & _fresh(rows["seed"], rows["context"], doc, rows["start"])  # equal rows are asked once
    asks = np.empty(int(asked.sum()), dtype=_ASK)
    for name in ("seed", "context", "start", "n", "off"):
        asks[name] = rows[name][asked]
    asks["split"] = contexts[asked] > most
    return _answers(doc[~leads], rows["start"][~leads].astype(np.int64), rows["n"][~leads].astype(np.int64), doc[asked], asks)


def _fetch(ids: list[int], texts: list[list[bytes]], asks: dict[int, list[bytes]], window: int, seed: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, kind and content: contexts by the bucket of their seed (0), or windows by that of their hash (1)."""
    heads: dict[int, list[tuple]] = {}
    bodies: dict[int, list[bytes]] = {}
    split: list[np.ndarray] = []
    for k, parts in dict(zip(ids, texts, strict=True)).items():  # rows that share a key are equal
        wanted = np.frombuffer(b"".join(asks[k]), dtype=_ASK)
        whole = wanted[wanted["split"] == 0]
        for s, start, n, off in zip(*(whole[c].tolist() for c in ("seed", "start", "n", "off")), strict=True):
            body = b" ".join(parts[start : start + n + window - 1])
            b = (s >> 32) % buckets
            heads.setdefault(b, []).append((s, k, start, n, off, len(body)))
            bodies.setdefault(b, []).append(body)
        rest = wanted[wanted["split"] == 1]
        if len(rest):
            prefix = common.prefix_hash(shingles.window_hashes(parts, 1))
            n = rest["n"].astype(np.int64)
            at = np.repeat(rest["start"].astype(np.int64) - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            rows = np.empty(len(at), dtype=_WINDOW)
            rows["seed"], rows["hash"], rows["doc"], rows["start"] = np.repeat(rest["seed"], n), common.span_hash(prefix, at, at + window), k, at
            split.append(rows)
    for b, found in heads.items():
        head = np.array(found, dtype=_PART)
        yield b, 0, np.array([len(head)], dtype="<u4").tobytes() + head.tobytes() + b" ".join(bodies[b])
    if split:
        rows = np.concatenate(split)
        bucket = (rows["hash"] >> U64(32)) % U64(buckets)
        by = np.argsort(bucket, kind="stable")
        for s, e in zip(*shingles.runs(bucket[by]), strict=True):
            yield int(bucket[by[s]]), 1, rows[by[s:e]].tobytes()


def _refine(numbers: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of what was equal so far and has the same next word too."""
    return np.unique(numbers * (int(words.max(initial=0)) + 2) + words + 1, return_inverse=True)[1]


def extended(head: np.ndarray, words: np.ndarray, window: int, seed: int, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of the windows that a smaller document has, of contexts with their words (as numbers) one after another."""
    rest = window - seed
    off, n = head["off"].astype(np.int64), head["n"].astype(np.int64)
    sizes = n + window - 1
    at = np.concatenate(([0], np.cumsum(sizes)[:-1])) + off  # the seed's first word
    numbers = np.zeros(len(head), dtype=np.int64)
    for i in range(seed):
        numbers = _refine(numbers, words[at + i])
    left, right = [numbers], [numbers]
    for i in range(rest):
        # Beyond a context's ends nothing is asked for: 0 stands there.
        left.append(_refine(left[-1], np.where(i < off, words[np.maximum(at - 1 - i, 0)], 0)))
        right.append(_refine(right[-1], np.where(seed + i < sizes - off, words[np.minimum(at + seed + i, len(words) - 1)], 0)))
    docs, starts = [], []
    for before in range(rest + 1):  # words of the window in front of the seed
        here = np.flatnonzero((before <= off) & (before > off - n))
        if not len(here):
            continue
        key = left[before][here] * len(head) + right[rest - before][here]
        order = np.lexsort((head["doc"][here], key))
        doc = head["doc"][here][order]
        fresh = _fresh(key[order])
        larger = doc >> shift > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] >> shift
        docs.append(doc[larger])
        starts.append((head["start"][here].astype(np.int64) + off[here] - before)[order][larger])
    return (np.concatenate(docs), np.concatenate(starts)) if docs else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))


def _extend(blobs: list[bytes], window: int, seed: int, shift: int) -> pa.Table:
    heads, words, number = [], [], {}
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
        heads.append(np.frombuffer(blob, dtype=_PART, count=n, offset=4))
        words += [number.setdefault(w, len(number)) for w in blob[4 + _PART.itemsize * n :].split(b" ")]
    doc, start = extended(np.concatenate(heads), np.array(words, dtype=np.int64), window, seed, shift)
    return _answers(doc, start, np.ones(len(doc), dtype=np.int64), doc[:0], np.empty(0, dtype=_ASK))


def _counted(blobs: list[bytes], shift: int) -> pa.Table:
    """The windows that a smaller document has, among hashed ones."""
    rows = np.concatenate([np.frombuffer(b, dtype=_WINDOW) for b in blobs])
    rows = rows[np.lexsort((rows["doc"], rows["seed"], rows["hash"]))]
    fresh = _fresh(rows["hash"], rows["seed"])
    rows = rows[rows["doc"] >> shift > rows["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] >> shift]
    return _answers(rows["doc"].astype(np.int64), rows["start"].astype(np.int64), np.ones(len(rows), dtype=np.int64), rows["doc"][:0].astype(np.int64), np.empty(0, dtype=_ASK))


def join_runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring or overlapping runs of one document as one run."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    reach = end.copy()
    # The farthest end so far within a document: ends are lifted by the document's number, so one scan serves all.
    number = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    lift = number * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift) - lift
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first], reach[last] - start[first]


def pack_texts(df: DataFrame, buckets: int, columns: list[str]) -> DataFrame:
    """bucket (of doc_id), text (compressed) and the named columns: what travels when texts are joined."""
    kept = ["doc_id", *columns]
    source = df.select(*kept, F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in common.settle(batches):
            data = pa.array([None if v is None else c.compress(v) for v in batch.column(len(kept) + 1).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], data], names=[*kept, "bucket", "text"])

    return source.mapInArrow(run, source.schema)


_FOUND = "doc_id long, runs binary, asks binary"


def repeats(docs: DataFrame, texts: DataFrame, buckets: int, window: int = WINDOW, seed: int = SEED, most: int = MOST, shift: int = 0) -> DataFrame:
    """bucket (of doc_id) and packed runs (doc_id, start, windows) of the repeated windows of documents (doc_id, text), whose
    packed texts are dealt to as many buckets. Ids are compared without their last `shift` bits (ranks.own_ids)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in shingles.groups_of(sizes, PACK):
                for c in range(a, b, 60_000):
                    d = min(b, c + 60_000)
                    yield packed_rows(list(_pack(batch.column(0)[c:d].to_pylist(), [shingles.words(t.as_py()) for t in batch.column(1)[c:d]], window, seed, buckets, shift)))

    def judge(group: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in group["rows"]]
        if group["kind"][0].as_py() == 0:
            return _judge(blobs, most, shift)
        known = np.concatenate([np.frombuffer(b, dtype=KNOWN) for b in blobs])
        return _answers(known["doc"].astype(np.int64), known["start"].astype(np.int64), known["n"].astype(np.int64), known["doc"][:0].astype(np.int64), np.empty(0, dtype=_ASK))

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        asks: dict[int, list[bytes]] = {}
        for k, blob in zip(right["doc_id"].to_pylist(), right["asks"].to_pylist(), strict=True):
            asks.setdefault(k, []).append(blob)
        d = zstandard.ZstdDecompressor()
        rows = [(k, d.decompress(t.as_py()).split()) for k, t in zip(left["doc_id"].to_pylist(), left["text"], strict=True) if k in asks and t.is_valid]
        return pa.Table.from_batches([packed_rows(list(_fetch([k for k, _ in rows], [p for _, p in rows], asks, window, seed, buckets)))])

    def find(group: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in group["rows"]]
        return _counted(blobs, shift) if group["kind"][0].as_py() else _extend(blobs, window, seed, shift)

    dealt, bucket = "bucket int, kind int, rows binary", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    packed = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(emit, dealt)
    judged = common.materialize(packed.groupBy("bucket", "kind").applyInArrow(judge, _FOUND).withColumn("bucket", bucket), "anchors")
    wanted = judged.where(F.octet_length("asks") > 0).select("bucket", "doc_id", "asks")
    contexts = texts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(fetch, dealt)
    more = contexts.groupBy("bucket", "kind").applyInArrow(find, _FOUND).withColumn("bucket", bucket)
    return judged.where(F.octet_length("runs") > 0).select("bucket", "doc_id", "runs").unionByName(more.select("bucket", "doc_id", "runs"))


def packed_rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "rows"])


def _spans(blobs: list[bytes]) -> np.ndarray:
    """Start and number of windows of one document's runs, joined."""
    r = np.frombuffer(b"".join(blobs), dtype="<u4").reshape(-1, 2).astype(np.int64)
    _, start, n = join_runs(np.zeros(len(r), dtype=np.int64), r[:, 0], r[:, 1])
    return np.stack((start, n), axis=1)


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, seed: int = SEED, most: int = MOST, digest: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Each document without the words that repeated windows cover.

    doc_id, n_words, n_removed and kept (the other words, joined by one space) or with digest kept_sha256. With carry,
    those columns of df come along, whatever their names, and texts from which nothing is removed stay as they are.
    """
    carry = carry or []
    common.text_batches(df.sparkSession)
    shared = ranks.own_ids(df, key, text)
    df, keys, shift = shared or (df, None, 0)
    inner = [f"__carry_{i}" for i in range(len(carry))]
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(x) for c, x in zip(carry, inner, strict=True)])
    n = common.buckets(df.sparkSession, df=df)
    texts = pack_texts(docs, n, inner)
    found = repeats(docs, texts, n, window, seed, most, shift)
    last = "kept_sha256" if digest else "kept"
    names = ["doc_id", *inner, "__n_words", "__n_removed", "__kept"]
    out = T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in inner), T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__kept", T.StringType())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        runs: dict[int, list[bytes]] = {}
        for k, blob in zip(right["doc_id"].to_pylist(), right["runs"].to_pylist(), strict=True):
            runs.setdefault(k, []).append(blob)
        d = zstandard.ZstdDecompressor()
        counts, removed, kept = [], [], []
        for k, blob in zip(left["doc_id"].to_pylist(), left["text"], strict=True):
            raw = b"" if blob.as_py() is None else d.decompress(blob.as_py())
            parts = raw.split()
            stay = parts
            if k in runs:
                cover = np.zeros(len(parts) + 1, dtype=np.int64)
                for start, many in _spans(runs[k]):
                    cover[start] += 1
                    cover[start + many + window - 1] -= 1
                stay = [w for w, gone in zip(parts, (np.cumsum(cover[:-1]) > 0).tolist(), strict=True) if not gone]
            counts.append(len(parts))
            removed.append(len(parts) - len(stay))
            if digest:
                kept.append(hashlib.sha256(b" ".join(stay)).hexdigest())
            elif carry and len(stay) == len(parts):
                kept.append(None if blob.as_py() is None else raw.decode())
            else:
                kept.append(b" ".join(stay).decode())
        return pa.table([left["doc_id"], *(left[c] for c in inner), pa.array(counts, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(kept, type=pa.string())], names=names)

    done = texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(cut, out)
    if keys:
        done = ranks.with_ids(done, keys, "doc_id")
    return done.select("doc_id", *[F.col(x).alias(c) for c, x in zip(carry, inner, strict=True)], F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept").alias(last))
