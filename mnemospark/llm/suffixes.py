"""Repeated byte strings by suffix arrays.

A string of `length` bytes is repeated if it starts at two places, in one document or in two; every byte that such a
string covers is removed. The suffixes of the whole corpus needn't be sorted for that: strings are winnowed, so equal
strings choose the same anchor (of the runs of SEED bytes inside, that of the smallest hash) at the same place, and only
strings with equal anchors can be equal. All strings of one anchor are neighbours; together with what they reach they are
the anchor's context.

1. Each anchor is a row of hashes: of the seed, and of the whole context. A context that comes twice is repeated from
   end to end; a seed that has one context only needs no further look.
2. The distinct contexts of the other seeds are fetched from the texts, one of each kind.
3. A task sorts the suffixes of its contexts in two stages: those smaller than their successor directly, the rest by
   scanning the buckets of first bytes in order. Common prefixes of adjacent suffixes of at least `length` bytes are the
   repeated strings.
4. Documents lose the bytes covered by both kinds of runs.

A seed with more contexts than `most` (a passage that stands in many documents amid different texts) isn't sorted in
one task, whose memory must stay bounded: its strings are hashed one by one (64 bits and a bucket), dealt by their own hash and
counted, which finds the same strings. Equal rows of one pack travel once; the others go straight to their documents. Hashes stand for seeds and contexts (64 bits each, and their bucket).

Null texts are empty. Rows that share an id are documents of their own, whether their texts are equal or not, and what two
of them have in common is repeated. A row without id is neither searched nor changed. Bytes left
by a cut need not be whole characters; `kept` is their decoding with the replacement character, kept_sha256 that of the bytes.
The size of the input, n_bytes, says nothing of what is removed: that is n_removed, n_spans and `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, ranks, shingles
from .windows import KNOWN, join_runs, pack_texts, packed_rows

U64 = np.uint64
LENGTH = 400
SEED = 128
PACK = 8 << 20
SLICE = 1 << 18
#: Contexts of one seed that are sorted in one task.
MOST = 1000


# --- Suffix arrays --------------------------------------------------------------------------------------------------


def _sort_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """These suffixes in the order of their first `depth` bytes, eight at a time, only ties going further."""
    padded = np.concatenate((text, np.zeros(depth + 16, dtype=np.int16)))
    order = places.copy()
    group = np.zeros(len(order), dtype=np.int64)  # suffixes that are equal so far share a number
    open_ = np.arange(len(order))
    for at in range(0, depth, 6):
        if not len(open_):
            break
        here = order[open_] + at
        word = np.zeros(len(open_), dtype=np.uint64)
        for i in range(6):  # six bytes of nine bits and one: the ends of contexts are below all bytes
            word = (word << U64(10)) | padded[np.minimum(here + i, len(padded) - 1)].astype(np.uint64)
        by = np.lexsort((word, group[open_]))
        order[open_] = order[open_][by]
        word, numbers = word[by], group[open_]
        fresh = np.concatenate(([True], (word[1:] != word[:-1]) | (numbers[1:] != numbers[:-1])))
        numbers = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        group[open_] = numbers
        single = fresh & np.concatenate((fresh[1:], [True]))
        open_ = open_[~single]
    return order


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of text (small whole numbers) in order, by their first `depth` numbers at least.

    With wanted (a boolean for each suffix), only those and the ones that they are induced from.

    Two stages: suffixes smaller than their successor are sorted directly; each other suffix is put behind those before
    it in the bucket of its first number when its successor is scanned.
    """
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    # Smaller than the successor: by the first of the following numbers that differs; the last suffix isn't.
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[-1] = -1
    told = np.flatnonzero(step)
    smaller = step[told[np.searchsorted(told, np.arange(n))]] > 0
    taken = np.ones(n, dtype=bool) if wanted is None else wanted.copy()
    ahead = np.flatnonzero(taken & ~smaller)
    while len(ahead):  # a suffix that isn't smaller than its successor needs that one
        ahead = ahead[ahead < n - 1] + 1
        ahead = ahead[~taken[ahead]]
        taken[ahead] = True
        ahead = ahead[~smaller[ahead]]
    direct = _sort_directly(text, np.flatnonzero(smaller & taken), depth)
    head = text[direct]
    top = int(text.max()) + 1
    starts = np.searchsorted(head, np.arange(top + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(top)]
    if taken[n - 1]:
        waiting[int(text[n - 1])].append(np.array([n - 1]))
    out = []
    for c in range(top):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, dtype=np.int64)
        induced = []
        while len(wave):  # a suffix may put others into its own bucket, which are scanned in turn
            induced.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & taken[before]]
        bucket = np.concatenate([*induced, direct[starts[c] : starts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~smaller[before] & taken[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            for s, e in zip(*shingles.runs(first[by]), strict=True):
                waiting[int(first[by[s]])].append(before[by[s:e]])
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many numbers each suffix shares with the one before it in order, up to `most`."""
    out = np.zeros(len(order), dtype=np.int64)
    n = len(text)
    alive = np.arange(1, len(order))
    step = 1
    while len(alive):
        a, b = order[alive] + out[alive], order[alive - 1] + out[alive]
        room = np.minimum(np.minimum(n - a, n - b), most - out[alive])
        grown = np.zeros(len(alive), dtype=np.int64)
        going = room > 0
        for i in range(step):
            going = going & (room > i)
            at = np.flatnonzero(going)
            if not len(at):
                break
            same = text[a[at] + i] == text[b[at] + i]
            grown[at[same]] += 1
            going[at[~same]] = False
        out[alive] += grown
        alive = alive[(grown == step) & (out[alive] < most)]
        step = min(64, step * 2)
    return out


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, where strings of `length` bytes start that start at another place of these contexts too."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(int(offsets[-1]), dtype=np.int16)  # contexts end in 0; bytes are 1 to 256
    for c, at in zip(contexts, offsets, strict=False):
        text[at : at + len(c)] = np.frombuffer(c, dtype=np.uint8).astype(np.int16) + 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    room = np.repeat(offsets[:-1] + sizes, sizes + 1) - np.arange(len(text))
    order = suffix_array(text, length, room >= length)
    shared = np.minimum(common_prefixes(text, order, length), np.minimum(room[order], np.concatenate(([0], room[order][:-1]))))
    twice = np.zeros(len(order), dtype=bool)
    twice[shared >= length] = True
    twice[:-1] |= shared[1:] >= length
    places = np.sort(order[twice])
    cut = np.searchsorted(owner[places], np.arange(len(contexts) + 1))
    return [places[cut[i] : cut[i + 1]] - offsets[i] for i in range(len(contexts))]


# --- Anchors --------------------------------------------------------------------------------------------------------

#: seed and context hashes; place of the text in the pack; first string, strings, and where the seed is from the first.
_ROW = np.dtype([("seed", "<u8"), ("context", "<u8"), ("doc", "<u2"), ("start", "<u4"), ("n", "<u4"), ("twice", "u1")])


def anchors(data: bytes, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, context hash, first string and number of strings of each anchor of a text."""
    out = []
    for first in range(0, max(0, len(data) - length + 1), SLICE):
        part = np.frombuffer(data[first : first + SLICE + length - 1], dtype=np.uint8)
        prefix = common.prefix_hash(part)
        at = np.arange(len(part) - seed + 1)
        seeds = common.span_hash(prefix, at, at + seed)
        chosen = shingles.sliding_argmin(seeds, length - seed + 1)
        s, e = shingles.runs(chosen)
        place = chosen[s] - s  # a context counts with the seed's place in it
        context = common.mix(common.span_hash(prefix, s, e + length - 1) + place.astype(np.uint64))
        out.append((seeds[chosen[s]], context, s + first, e - s))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _pack(ids: list[int], texts: list[bytes], length: int, seed: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, kind and content: anchors by their seed (0), of equal ones one, and what repeats one of this pack by document (1)."""
    found = [anchors(t, length, seed) for t in texts]
    rows = np.empty(sum(len(f[0]) for f in found), dtype=_ROW)
    if not len(rows):
        return
    for name, i in (("seed", 0), ("context", 1), ("start", 2), ("n", 3)):
        rows[name] = np.concatenate([f[i] for f in found])
    rows["doc"] = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    order = np.lexsort((rows["context"], rows["seed"]))
    same = rows["context"][order]
    heads, tails = shingles.runs(same)
    many = np.empty(len(rows), dtype=np.uint8)
    many[order] = np.repeat(tails - heads > 1, tails - heads)
    rows["twice"] = many
    # One of equal anchors is sent, so that others learn of it; the rest are repeated for certain and concern their documents alone.
    ids, rest = np.array(ids, dtype=np.int64), np.ones(len(rows), dtype=bool)
    rest[order[heads]] = False
    sent = rows[~rest]
    bucket = (sent["seed"] >> U64(32)) % U64(buckets)
    by = np.argsort(bucket, kind="stable")
    for s, e in zip(*shingles.runs(bucket[by]), strict=True):
        r = sent[by[s:e]]
        used = np.unique(r["doc"])
        r["doc"] = np.searchsorted(used, r["doc"])
        yield int(bucket[by[s]]), 0, np.array([len(used)], dtype="<u4").tobytes() + ids[used].astype("<i8").tobytes() + r.tobytes()
    if rest.any():
        doc, start, n = join_runs(ids[rows["doc"][rest]], rows["start"][rest].astype(np.int64), rows["n"][rest].astype(np.int64))
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


_FOUND = "doc_id long, runs binary, asks binary"
#: What a text is asked for: its strings from `start` on, for which seed, and whether in pieces.
_ASK = np.dtype([("seed", "<u8"), ("start", "<u4"), ("n", "<u4"), ("split", "u1")])


def _known(blobs: list[bytes]) -> pa.Table:
    """What is repeated already, by document."""
    rows = np.concatenate([np.frombuffer(b, dtype=KNOWN) for b in blobs])
    doc, start, n = join_runs(rows["doc"].astype(np.int64), rows["start"].astype(np.int64), rows["n"].astype(np.int64))
    heads, tails = shingles.runs(doc)
    spans = np.stack((start, n), axis=1).astype("<u4")
    return pa.table({"doc_id": pa.array(doc[heads], type=pa.int64()), "runs": pa.array([spans[s:e].tobytes() for s, e in zip(heads, tails, strict=True)], type=pa.binary()), "asks": pa.array([b""] * len(heads), type=pa.binary())})


def _judge(blobs: list[bytes], most: int) -> pa.Table:
    """What is repeated from end to end, and which contexts must be fetched, by document."""
    doc, rows = map(np.concatenate, zip(*map(_unpack, blobs), strict=True))
    order = np.lexsort((rows["context"], rows["seed"]))
    seed, context = rows["seed"][order], rows["context"][order]
    fresh = np.concatenate(([True], (seed[1:] != seed[:-1]) | (context[1:] != context[:-1])))
    number = np.cumsum(fresh) - 1
    size = np.bincount(number)
    repeated = np.zeros(len(rows), dtype=bool)
    repeated[order] = size[number] > 1
    repeated |= rows["twice"] > 0
    # Distinct contexts of each seed.
    heads = np.flatnonzero(fresh)
    seed_fresh = np.concatenate(([True], seed[heads][1:] != seed[heads][:-1]))
    contexts = np.bincount(np.cumsum(seed_fresh) - 1)[np.cumsum(seed_fresh) - 1]
    asked = order[heads[contexts > 1]]
    split = (contexts > most)[contexts > 1]
    asks = np.empty(len(asked), dtype=_ASK)
    asks["seed"], asks["start"], asks["n"], asks["split"] = rows["seed"][asked], rows["start"][asked], rows["n"][asked], split
    run_doc, run_start, run_n = join_runs(doc[repeated], rows["start"][repeated].astype(np.int64), rows["n"][repeated].astype(np.int64))
    ids = np.unique(np.concatenate((run_doc, doc[asked])))
    by = np.argsort(doc[asked], kind="stable")
    asks, asked_doc = asks[by], doc[asked][by]
    spans = np.stack((run_start, run_n), axis=1).astype("<u4")
    a, b = np.searchsorted(run_doc, ids), np.searchsorted(run_doc, ids, side="right")
    c, d = np.searchsorted(asked_doc, ids), np.searchsorted(asked_doc, ids, side="right")
    return pa.table({
        "doc_id": pa.array(ids, type=pa.int64()),
        "runs": pa.array([spans[i:j].tobytes() for i, j in zip(a, b, strict=True)], type=pa.binary()),
        "asks": pa.array([asks[i:j].tobytes() for i, j in zip(c, d, strict=True)], type=pa.binary()),
    })


# --- The operator ---------------------------------------------------------------------------------------------------

_PART = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u4")])
_STRING = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<u4")])
#: Bytes of contexts in one suffix array.
SORTED = 1 << 21


def _fetch(ids: list[int], texts: list[bytes], asks: dict[int, list[bytes]], length: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, kind and content: contexts by the bucket of their seed (0), or strings by that of their hash (1)."""
    parts: dict[int, list[tuple]] = {}
    strings: list[np.ndarray] = []
    for k, data in zip(ids, texts, strict=True):
        if k not in asks:
            continue
        for ask in np.frombuffer(b"".join(asks[k]), dtype=_ASK):
            seed, start, n = int(ask["seed"]), int(ask["start"]), int(ask["n"])
            context = data[start : start + n + length - 1]
            if len(context) < length:
                continue
            if ask["split"]:
                prefix = common.prefix_hash(np.frombuffer(context, dtype=np.uint8))
                at = np.arange(len(context) - length + 1)
                rows = np.empty(len(at), dtype=_STRING)
                rows["hash"], rows["doc"], rows["start"] = common.span_hash(prefix, at, at + length), k, start + at
                strings.append(rows)
            else:
                parts.setdefault((seed >> 32) % buckets, []).append((seed, k, start, context))
    for b, found in parts.items():
        head = np.array([(s, k, start, len(c)) for s, k, start, c in found], dtype=_PART)
        yield b, 0, np.array([len(head)], dtype="<u4").tobytes() + head.tobytes() + b"".join(c for *_, c in found)
    if strings:
        rows = np.concatenate(strings)
        bucket = (rows["hash"] >> U64(32)) % U64(buckets)
        by = np.argsort(bucket, kind="stable")
        for s, e in zip(*shingles.runs(bucket[by]), strict=True):
            yield int(bucket[by[s]]), 1, rows[by[s:e]].tobytes()


def _runs_of(doc: np.ndarray, start: np.ndarray) -> pa.Table:
    doc, start, n = join_runs(doc, start, np.ones(len(doc), dtype=np.int64))
    heads, tails = shingles.runs(doc)
    spans = np.stack((start, n), axis=1).astype("<u4") if len(doc) else np.empty((0, 2), dtype="<u4")
    return pa.table({"doc_id": pa.array(doc[heads], type=pa.int64()), "runs": pa.array([spans[s:e].tobytes() for s, e in zip(heads, tails, strict=True)], type=pa.binary())})


def _sorted_repeats(blobs: list[bytes], length: int) -> pa.Table:
    """The repeated strings of contexts, by suffix arrays over some seeds at a time."""
    heads, bodies = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
        head = np.frombuffer(blob, dtype=_PART, count=n, offset=4)
        at = 4 + _PART.itemsize * n
        cuts = at + np.concatenate(([0], np.cumsum(head["size"].astype(np.int64))))
        heads.append(head)
        bodies += [blob[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    head = np.concatenate(heads)
    order = np.argsort(head["seed"], kind="stable")
    docs, starts = [], []
    firsts, ends = shingles.runs(head["seed"][order])
    sizes = np.add.reduceat(head["size"][order].astype(np.int64), firsts) if len(firsts) else firsts
    for a, b in shingles.groups_of(sizes.tolist(), SORTED):
        mine = order[firsts[a] : ends[b - 1]]
        for i, found in zip(mine, repeated_starts([bodies[i] for i in mine], length), strict=True):
            docs.append(np.full(len(found), head["doc"][i], dtype=np.int64))
            starts.append(found + int(head["start"][i]))
    return _runs_of(np.concatenate(docs), np.concatenate(starts))


def _counted_repeats(blobs: list[bytes]) -> pa.Table:
    """The repeated strings among hashed ones."""
    rows = np.concatenate([np.frombuffer(b, dtype=_STRING) for b in blobs])
    order = np.argsort(rows["hash"], kind="stable")
    heads, tails = shingles.runs(rows["hash"][order])
    rows = rows[order][np.repeat(tails - heads > 1, tails - heads)]
    return _runs_of(rows["doc"].astype(np.int64), rows["start"].astype(np.int64))


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, seed: int | None = None, most: int = MOST, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, with digest kept_sha256, and kept, of every document."""
    seed = seed or max(1, length * 8 // 25)
    common.text_batches(df.sparkSession)
    shared = ranks.own_ids(df, key, text)
    df, keys, _ = shared or (df, None, 0)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = common.buckets(df.sparkSession, df=df)
    texts = pack_texts(docs, n, [])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in shingles.groups_of(sizes, PACK):
                for c in range(a, b, 60_000):
                    d = min(b, c + 60_000)
                    found = list(_pack(batch.column(0)[c:d].to_pylist(), [v or b"" for v in batch.column(1)[c:d].to_pylist()], length, seed, n))
                    yield packed_rows(found)

    def judge(group: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in group["rows"]]
        return _known(blobs) if group["kind"][0].as_py() else _judge(blobs, most)

    packed = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary")).mapInArrow(emit, "bucket int, kind int, rows binary")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    judged = common.materialize(packed.groupBy("bucket", "kind").applyInArrow(judge, _FOUND).withColumn("bucket", bucket), "anchors")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        asks: dict[int, list[bytes]] = {}
        for k, blob in zip(right["doc_id"].to_pylist(), right["asks"].to_pylist(), strict=True):
            asks.setdefault(k, []).append(blob)
        d = zstandard.ZstdDecompressor()
        rows = [(k, d.decompress(t)) for k, t in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True) if k in asks and t is not None]
        # As many buckets as partitions: contexts are few beside the texts, and rows should be worth their while.
        out = list(_fetch([k for k, _ in rows], [t for _, t in rows], asks, length, max(1, n // 4)))
        return pa.Table.from_batches([packed_rows(out)])

    def find(group: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in group["rows"]]
        return _counted_repeats(blobs) if group["kind"][0].as_py() else _sorted_repeats(blobs, length)

    wanted = judged.where(F.octet_length("asks") > 0).select("bucket", "doc_id", "asks")
    contexts = texts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(fetch, "bucket int, kind int, rows binary")
    sorted_ = contexts.groupBy("bucket", "kind").applyInArrow(find, "doc_id long, runs binary").withColumn("bucket", bucket)
    runs = judged.where(F.octet_length("runs") > 0).select("doc_id", "runs", "bucket").unionByName(sorted_)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[bytes]] = {}
        for k, blob in zip(right["doc_id"].to_pylist(), right["runs"].to_pylist(), strict=True):
            found.setdefault(k, []).append(blob)
        d = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        for k, blob in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True):
            data = b"" if blob is None else d.decompress(blob)
            spans = []
            if k in found:
                r = np.frombuffer(b"".join(found[k]), dtype="<u4").reshape(-1, 2).astype(np.int64)
                _, s, m = join_runs(np.zeros(len(r), dtype=np.int64), r[:, 0], r[:, 1] + length - 1)
                spans = [(a, a + b) for a, b in zip(s.tolist(), m.tolist(), strict=True) if b]
            edges = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((k, len(data), len(data) - len(kept), len(spans), kept))
        names = [*counts, "kept"]
        return pa.table({c: pa.array(v, type=pa.binary() if c == "kept" else pa.int64()) for c, v in zip(names, list(zip(*out, strict=True)) or [[]] * 5, strict=True)})

    counts = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in counts), T.StructField("kept", T.BinaryType())])
    done = texts.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(cut, schema)
    if keys:
        done = ranks.with_ids(done, keys, "doc_id")
    sums = [F.sha2("kept", 256).alias("kept_sha256")] if digest else []
    return done.select(*counts, *sums, F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"))
