"""Near-duplicate documents by DartMinHash over shingles of five words.

A shingle of weight w is a region of that width; darts hit it as a Poisson process in rank, one hash after another
giving the next dart's rank, place and coordinate, and a dart that lands beyond the weight misses. A document looks at
ranks up to the level where K ln K + 2K darts are to be expected, so most shingles of a long document throw none, and
keeps the earliest dart of each of K coordinates; a document that has an empty coordinate doubles the level. Two documents
agree in a coordinate with a chance equal to their weighted Jaccard similarity. With weights of one, as here by
default, that is the Jaccard similarity of their sets of shingles; weights may be how often a shingle comes.

Bands of ROWS coordinates are joined. The member of a bucket that meets most others (in all its buckets; then the smallest) is its leader and is compared with each of the
others, exactly, on their shingles. Where that leaves a leader's documents in more than one component, they are compared
with each other where they can be alike at all (see _open_links), which for copies with edits of their own means hardly
ever. Groups of more than CROWD for one reason are dealt by further bands first, and what these leave apart is compared by
the shingles that it must share (see _rest_links), so every link of a group is found, whatever its size. So links that join
components aren't lost, a large group of copies costs a comparison for each member, and a leader of many unlike documents
doesn't set them all against each other. Equal texts are one document from the start.

Null texts count as empty. Texts without words are like equal texts only; texts of one to four words have one shingle,
all their words. Rows that share an id but not the text have each the class of
their own text; rows with a null id have a null class.
A pair at the similarity sought shares no band with a chance of (1 - 0.8^5)^24, 0.007 percent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, graph, ranks, shingles

U64 = np.uint64
WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
K = BANDS * ROWS
DARTS = K * (np.log(K) + 2)
#: Members of one group that are compared with each other, and the further bands by which a part of a larger group is dealt.
CROWD = 1024
STEPS = 4
#: Shingles of a block of documents that one task compares with another block.
BLOCK = 1 << 20


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _darts(elements: np.ndarray, weights: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the element, coordinate hash and rank of all darts below each element's level.

    The region of an element is cut at 1, 2, 4, ... in width, so that heavier ones repeat the darts of lighter ones.
    """
    where, hashes, ranks = [], [], []
    low, width = 0.0, 1.0
    while len(live := np.flatnonzero(weights > low)):
        h = common.mix(elements[live] + U64((int(low) * 2 + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        rank = np.zeros(len(live))
        while len(live):
            h = common.mix(h + U64(0x9E3779B97F4A7C15))
            rank = rank - np.log(_uniform(h)) / width
            keep = rank < level[live]
            live, h, rank = live[keep], h[keep], rank[keep]
            place = common.mix(h ^ U64(0x5851F42D4C957F2D))
            hit = low + width * _uniform(place) <= weights[live]
            where.append(live[hit])
            hashes.append(common.mix(place + U64(1))[hit])
            ranks.append(rank[hit])
        low, width = (1.0, 1.0) if low == 0 else (low * 2, low * 2)
    if not where:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0)
    return np.concatenate(where), np.concatenate(hashes), np.concatenate(ranks)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """K coordinates of each weighted set (elements, weights); sets must not be empty."""
    out = np.zeros((len(sets), K), dtype=np.uint64)
    todo = np.arange(len(sets))
    level = np.array([DARTS / w.sum() for _, w in sets])
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        at, h, rank = _darts(elements, weights, level[todo][owner])
        slot = owner[at] * K + (h % U64(K)).astype(np.int64)
        order = np.lexsort((rank, slot))
        first = order[np.concatenate(([True], slot[order][1:] != slot[order][:-1]))] if len(order) else order
        full = np.zeros(len(todo) * K, dtype=bool)
        values = np.zeros(len(todo) * K, dtype=np.uint64)
        full[slot[first]] = True
        values[slot[first]] = h[first]
        done = full.reshape(-1, K).all(axis=1)
        out[todo[done]] = values.reshape(-1, K)[done]
        level[todo[~done]] *= 2
        todo = todo[~done]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each row of signatures."""
    out = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        out = common.mix(out * U64(common.BASE) + signature[:, r * BANDS : (r + 1) * BANDS])
    return common.mix(out + np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_set(text: str | None, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    found, n = np.unique(shingles.window_hashes(shingles.words(text), WORDS), return_counts=True)
    return found, n.astype(np.float64) if weighted else np.ones(len(found))


def jaccard(a: bytes, b: bytes, weighted: bool = False) -> float:
    """The weighted Jaccard similarity of two packed shingle sets."""
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    if weighted:
        (x, wx), (y, wy) = ((v[0::2], v[1::2].astype(np.float64)) for v in (x, y))
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = np.minimum(wx[i], wy[j]).sum()
        return float(both / (wx.sum() + wy.sum() - both)) if len(x) and len(y) else 0.0
    if not len(x) or not len(y):
        return 0.0
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(x) + len(y) - both)


def _sketch(docs: DataFrame, weighted: bool) -> DataFrame:
    """doc_id, text_key, n (weight of all shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            texts = batch.column(2)
            # A document throws some hundred darts, however short it is.
            size = [4096 + n for n in pa.compute.binary_length(texts).fill_null(0).to_pylist()]
            for a, b in shingles.groups_of(size, 1 << 20):
                sets = [shingle_set(t.as_py(), weighted) for t in texts[a:b]]
                some = [i for i, s in enumerate(sets) if len(s[0])]
                found = bands(signatures([sets[i] for i in some])).view(np.int64) if some else np.zeros((0, BANDS), dtype=np.int64)
                rows: list = [None] * (b - a)
                for i, r in zip(some, found, strict=True):
                    rows[i] = r
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array([float(s[1].sum()) for s in sets]), pa.array(rows, type=pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "bands"]
                )

    return docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key binary, n double, bands array<long>")


def _sets(docs: DataFrame, weighted: bool) -> DataFrame:
    """doc_id, shingles (packed) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            out = []
            for t in batch.column(1):
                s, w = shingle_set(t.as_py(), weighted)
                out.append((np.stack((s, w.astype("<u8")), axis=1) if weighted else s).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _packed(blob: bytes | np.ndarray, weighted: bool) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u8")[:: 2 if weighted else 1]


def _verify(pairs: DataFrame, sets: DataFrame, weighted: bool, similarity: float) -> DataFrame:
    """Pairs (a, b) with their similarity, the shingles they share and have, and the first of a's that b lacks.

    If two documents are alike, and the one has at least `first` shingles that b lacks, they share one of those, as the
    first n - ceil(similarity n) + 1 shingles in any order do (here: those that b lacks, by their hash, and then the others).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            near, both, n_a, lacks = [], [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                near.append(jaccard(x, y, weighted))
                a, b = _packed(x, weighted), _packed(y, weighted)
                at = np.searchsorted(b, a) if len(b) else np.zeros(len(a), dtype=np.int64)
                inside = b[np.minimum(at, len(b) - 1)] == a if len(b) else np.zeros(len(a), dtype=bool)
                both.append(int(inside.sum()))
                n_a.append(len(a))
                first = len(a) if weighted else len(a) - int(np.ceil(similarity * len(a) - 1e-9)) + 1
                lacks.append(a[~inside][:first].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(4), pa.array(near, type=pa.float64()), pa.array(both, type=pa.int64()), pa.array(n_a, type=pa.int64()), pa.array(lacks, type=pa.list_(pa.int64()))],
                names=["a", "b", "degree", "near", "both", "n", "lacks"],
            )

    pairs = pairs if "degree" in pairs.columns else pairs.withColumn("degree", F.lit(0).cast("long"))
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    # Sorted joins at every size: how much travels then follows the input.
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y", "degree").mapInArrow(run, "a long, b long, degree long, near double, both long, n long, lacks array<long>")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) of known ones and more links."""
    return common.materialize(graph.components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b"))), "classes")


def _dealt(groups: DataFrame, texts: DataFrame, crowd: int) -> DataFrame:
    """Candidates (a, b) among the members of groups (key, a, component) that are too large for all to be compared.

    A group is dealt by the bands of its members, and a part that is still larger than `crowd` by further bands, STEPS
    times over: documents that are alike share many bands. A member meets at most `crowd` others in each part, and of a
    group a part remains that is the fifth power of how alike its members are (of unlike halves, one in 243).
    """
    level = groups.join(texts.select(F.col("rep").alias("a"), "bands").hint("merge"), "a")
    level = level.select("a", "component", "bands", F.posexplode("bands").alias("i", "band")).join(groups.select("key", "a"), "a").select(F.xxhash64("key", "band").alias("key"), "a", "component", "i", "bands")
    found = None
    for depth in range(1 + (BANDS - 1) // STEPS):
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key", "size")
        mixed = common.materialize(level.join(sizes, "key"), "groups")
        small = mixed.where(F.col("size") <= crowd).select("key", "a", "component")
        pairs = small.join(small.select("key", F.col("a").alias("b"), F.col("component").alias("other")), "key").where("a < b and component != other").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        large = mixed.where(F.col("size") > crowd)
        if large.isEmpty():
            break
        further = F.transform(F.sequence(F.lit(1 + depth * STEPS), F.lit((depth + 1) * STEPS)), lambda s: F.xxhash64("key", s, F.get("bands", F.pmod(F.col("i") + s, F.lit(BANDS)))))
        level = large.select(F.explode(further).alias("key"), "a", "component", "i", "bands")
    return found


def _alike(x: pa.Table, y: pa.Table, same: bool, weighted: bool, similarity: float) -> tuple[list[int], list[int]]:
    """Links between two blocks of documents (a, component, shingles) in different components, or within one if they are the same."""
    step = 2 if weighted else 1
    blobs = [np.frombuffer(v.as_py(), dtype="<u8") for v in x["shingles"]]
    parts, heavy = [b[::step] for b in blobs], [b[1::2].astype(np.float64) if weighted else np.ones(len(b)) for b in blobs]
    owner = np.repeat(np.arange(len(parts)), [len(v) for v in parts])
    tokens, weight = np.concatenate(parts), np.concatenate(heavy)
    order = np.argsort(tokens, kind="stable")
    owner, weight = owner[order], weight[order]
    names, starts, counts = np.unique(tokens[order], return_index=True, return_counts=True)
    total, ids, within = np.array([w.sum() for w in heavy]), x["a"].to_numpy(), x["component"].to_numpy()
    left, right = [], []
    for a, component, blob in zip(y["a"].to_pylist(), y["component"].to_pylist(), y["shingles"], strict=True):
        row = np.frombuffer(blob.as_py(), dtype="<u8")
        mine, w = row[::step], row[1::2].astype(np.float64) if weighted else np.ones(len(row))
        at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
        hit = names[at] == mine
        at, size = at[hit], counts[at[hit]]
        places = np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        both = np.bincount(owner[places], weights=np.minimum(weight[places], np.repeat(w[hit], size)), minlength=len(ids))
        found = (both / (total + w.sum() - both) >= similarity) & (within != component) & ((ids < a) if same else True)
        left += ids[found].tolist()
        right += [a] * int(found.sum())
    return left, right


def _rest_links(groups: DataFrame, joined: DataFrame, sets: DataFrame, weighted: bool, similarity: float, crowd: int) -> DataFrame:
    """All links (a, b) between documents of groups (key, a) that lie in different components.

    Shingles are ordered by the number of documents that have them, the rarest first. The first one that two documents share is
    followed by all others that they share, so if they are alike, at least the part `similarity` of either one's weight begins there:
    documents meet by their shingles up to that place. Those that meet are compared in pairs where they are `crowd` at most,
    else block by block, so that a task holds two blocks, and nothing is made for a pair that isn't a link.
    """
    inside = groups.join(joined.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    apart = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    members = common.materialize(inside.join(apart, "key", "left_semi").select("a", "component").distinct(), "crowds")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            for a, b in shingles.groups_of([v.as_buffer().size if v.is_valid else 0 for v in batch.column(2)], 8 << 16):
                rows = [np.frombuffer(v.as_py(), dtype="<u8") for v in batch.column(2)[a:b]]
                sizes = [len(_packed(r, weighted)) for r in rows]
                t = np.concatenate([_packed(r, weighted) for r in rows])
                w = np.concatenate([r[1::2] for r in rows]).astype(np.float64) if weighted else np.ones(len(t))
                ids, parts = (np.repeat(batch.column(i)[a:b].to_numpy(), sizes) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(parts), pa.array(t.view(np.int64)), pa.array(w)], names=["a", "component", "t", "w"])

    own = members.join(sets.select(F.col("doc_id").alias("a"), "shingles").hint("merge"), "a")
    tokens = common.materialize(own.select("a", "component", "shingles").mapInArrow(spread, "a long, component long, t long, w double"), "tokens")
    known = tokens.groupBy("t").agg(F.count("*").alias("df"))
    later = Window.partitionBy("a").orderBy(F.desc("df"), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.join(known, "t").withColumns({"rest": F.sum("w").over(later), "n": F.sum("w").over(Window.partitionBy("a"))})
    placed = common.materialize(placed.where((F.col("df") > 1) & (F.col("rest") >= similarity * F.col("n") - 1e-9)).select("t", "df", "a", "component", "n", "rest"), "tokens")
    # Shingles of the same documents make one group: the first of them, after which the most is left.
    met = placed.groupBy("t", "df").agg(
        F.count("*").alias("size"), F.sum("n").alias("held"), F.bit_xor(F.xxhash64("a")).alias("x"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("y"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    met = met.where("lo != hi").groupBy("size", "x", "y").agg(F.min(F.struct("df", "t")).alias("f"), F.max("held").alias("held")).select(F.col("f.t").alias("t"), "size", "held")
    met = common.materialize(placed.join(met, "t").select("t", "size", "held", "a", "component", "n", "rest"), "groups")
    few = met.where(F.col("size") <= crowd)
    other = few.select("t", *[F.col(c).alias(f"y_{c}") for c in ("a", "component", "n", "rest")])
    can = (F.col("a") < F.col("y_a")) & (F.col("component") != F.col("y_component")) & (F.least("rest", "y_rest") >= similarity / (1 + similarity) * (F.col("n") + F.col("y_n")) - 1e-9)
    pairs = few.join(other, "t").where(can).select("a", F.col("y_a").alias("b")).distinct()
    found = _verify(pairs, sets, weighted, similarity).where(F.col("near") >= similarity).select("a", "b")
    many = met.where(F.col("size") > crowd)
    if many.isEmpty():
        return found

    def compare(group: pa.Table) -> pa.Table:
        mine = group["block"].to_numpy()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        x, y = group.filter(pa.array(mine == i)), group.filter(pa.array(mine == j))
        a, b = _alike(x, y, i == j, weighted, similarity) if len(x) and len(y) else ([], [])
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    blocks = F.greatest(F.ceil(F.col("size") / crowd), F.ceil(F.col("held") / BLOCK)).cast("int")
    dealt = many.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "a", "component")
    dealt = dealt.join(sets.select(F.col("doc_id").alias("a"), "shingles").hint("merge"), "a").select("t", "i", "j", "block", "a", "component", "shingles")
    return found.unionByName(dealt.groupBy("t", "i", "j").applyInArrow(compare, "a long, b long"))


def _open_links(first: DataFrame, joined: DataFrame, sets: DataFrame, texts: DataFrame, weighted: bool, similarity: float, crowd: int) -> DataFrame:
    """Components with the links between documents that were compared with the same leader, but not with each other.

    Two of them that are alike share a shingle that the leader lacks, or both have the part `similarity` of their shingles
    in common with the leader. Documents with such a shingle in common are compared with one of them, chosen as leaders
    are. Only where that leaves several components they are compared with each other, and so are those of the second kind
    with the ones among them that aren't in the leader's component: where there are `crowd` of either at most, else by bands and
    then, in groups that still lie in several components, by the shingles that they must share.
    """
    large = []
    where = lambda df, j: df.join(j.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    mixed = where(first.select("a", "b"), joined).groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("b")
    star = common.materialize(where(first.join(mixed, "b", "left_semi"), joined), "stars")
    tokens = star.select("b", "a", "near", "degree", "component", F.explode("lacks").alias("t"))
    several = lambda df: df.groupBy("b", "t").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.max(F.struct("degree", (-F.col("a")).alias("less"), "component")).alias("m")).where("lo != hi").select("b", "t", "size", (-F.col("m.less")).alias("lead"), F.col("m.component").alias("lead_in"))
    by_token = tokens.join(several(tokens), ["b", "t"]).where("component != lead_in").select("a", F.col("lead").alias("b")).distinct()

    # Of shingles in common with the leader, documents that are alike have similarity / (1 + similarity) of both their
    # numbers. So each bounds the other's number, and they meet by the range that the other's is in.
    share = similarity / (1 + similarity)
    inside = star if weighted else star.where(F.col("both") >= similarity * F.col("n") - 1e-9)
    of_leader = joined.select(F.col("node").alias("b"), F.col("component").alias("leader_in"))
    inside = inside.join(of_leader, "b", "left").withColumn("out", F.col("component") != F.coalesce("leader_in", "b")).select("b", "a", "both", "n", "near", "component", "out")
    span = lambda x: F.floor(F.log(x) / float(np.log(1.1)) + 1e-9)
    least, most = F.col("n") * similarity, F.least(F.col("n") / similarity, F.col("both") / share - F.col("n"))
    if weighted:  # numbers of shingles bound nothing then
        seekers, inside = inside.where("out").withColumn("range", F.lit(0).cast("long")), inside.withColumn("range", F.lit(0).cast("long"))
    else:
        seekers = inside.where(F.col("out") & (most >= least - 1e-9)).withColumn("range", F.explode(F.sequence(span(least), F.greatest(span(least), span(most)))))
        inside = inside.withColumn("range", span(F.col("n")))
    seekers = common.materialize(seekers.withColumn("size", F.count("*").over(Window.partitionBy("b", "range"))), "stars")
    side = lambda p, df: df.select("b", "range", *[F.col(c).alias(f"{p}_{c}") for c in ("a", "both", "n", "near", "component", "out")])
    need = F.lit(0.0) if weighted else share * (F.col("x_n") + F.col("y_n")) - 1e-9
    once = ~F.col("y_out") | (F.col("x_a") < F.col("y_a"))
    apart = F.abs(F.col("x_near") - F.col("y_near")) <= 1 - similarity + 1e-9  # as one minus similarity is a metric
    rest = side("x", seekers.where(F.col("size") <= crowd)).join(side("y", inside), ["b", "range"]).where(once & apart & (F.col("x_component") != F.col("y_component")) & (F.least("x_both", "y_both") >= need))
    asked = by_token.unionByName(rest.select(F.col("x_a").alias("a"), F.col("y_a").alias("b")))
    many = seekers.where(F.col("size") > crowd)
    if not many.isEmpty():
        met = many.drop("size").unionByName(inside.join(many.select("b", "range").distinct(), ["b", "range"], "left_semi"))
        large.append(common.materialize(met.select(F.xxhash64("b", "range").alias("key"), "a", "component").distinct(), "crowds"))
        asked = asked.unionByName(_dealt(large[-1], texts, crowd))
    more = common.materialize(_verify(asked.distinct(), sets, weighted, similarity).where(F.col("near") >= similarity).select("a", "b"), "pairs")
    if not more.isEmpty():
        joined = _joined(joined, more)

    tokens = where(tokens.drop("component"), joined)
    left = common.materialize(tokens.join(several(tokens), ["b", "t"]).where("a != lead").select("b", "t", "size", "a", "near", "component").join(star.select("b", "a", "lacks"), ["b", "a"]), "stars")
    few = left.where(F.col("size") <= crowd)
    other = few.select("b", "t", F.col("a").alias("y"), F.col("near").alias("y_near"), F.col("component").alias("y_in"), F.col("lacks").alias("y_lacks"))
    can = (F.col("a") < F.col("y")) & (F.col("component") != F.col("y_in")) & (F.abs(F.col("near") - F.col("y_near")) <= 1 - similarity + 1e-9)
    can = can & (F.array_min(F.array_intersect("lacks", "y_lacks")) == few["t"])  # once, however many they share
    last = few.join(other, ["b", "t"]).where(can).select("a", F.col("y").alias("b"))
    many = left.where(F.col("size") > crowd)
    if not many.isEmpty():
        large.append(common.materialize(many.select(F.xxhash64("b", "t").alias("key"), "a", "component"), "crowds"))
        last = last.unionByName(_dealt(large[-1], texts, crowd))
    late = common.materialize(_verify(last.distinct(), sets, weighted, similarity).where(F.col("near") >= similarity).select("a", "b"), "pairs")
    joined = joined if late.isEmpty() else _joined(joined, late)
    for groups in large:
        more = common.materialize(_rest_links(groups.select("key", "a"), joined, sets, weighted, similarity, crowd), "pairs")
        joined = joined if more.isEmpty() else _joined(joined, more)
    return joined


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, weighted: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, class_id (the smallest id of the group), kept (it is that one) for each row of df.

    Rows that share an id but not the text have each the class of their own text.
    """
    if shared := ranks.own_ids(df, key, text):
        found = _classes(shared[0], text, key, similarity, weighted, crowd)
        return ranks.with_ids(found, shared[1], "doc_id", "class_id")
    return _classes(df, text, key, similarity, weighted, crowd)


def _classes(df: DataFrame, text: str, key: str, similarity: float, weighted: bool, crowd: int) -> DataFrame:
    """classes(), where rows that share an id are equal."""
    common.text_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketch = common.materialize(_sketch(docs, weighted), "sketches")
    known = sketch.where(F.col("doc_id").isNotNull())
    # A text's sketch is the same in all its copies, so copies meet before anything is joined.
    texts = known.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = texts.where(F.col("bands").isNotNull()).select("rep", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    crowded = common.materialize(banded.join(sizes, "band"), "bands")
    # A bucket's leader is the member that meets most others in all its buckets: the one nearest to what they have in common.
    degree = crowded.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = common.materialize(crowded.select("band", "rep").join(degree, "rep"), "bands")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("less"))).alias("lead")).select("band", (-F.col("lead.less")).alias("lead"))
    members = common.materialize(ranked.join(leaders, "band").select("rep", "lead", "degree").distinct(), "buckets")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = common.materialize(_sets(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), weighted), "shingles")
    asked = members.where("rep != lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"), "degree")
    first = common.materialize(_verify(asked, sets, weighted, similarity), "pairs")
    joined = common.materialize(graph.components(first.where(F.col("near") >= similarity).select("a", "b")), "classes")
    joined = _open_links(first, joined, sets, texts, weighted, similarity, crowd)

    of_text = texts.select("text_key", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("text_key", F.coalesce("component", "rep").alias("class_id"))
    # Written first, so that the join below stands on two plain exchanges, of which Spark splits one with a very common text.
    of_text = common.materialize(of_text, "classes")
    out = known.select("doc_id", "text_key").join(of_text, "text_key").select("doc_id", "class_id")
    return out.unionByName(sketch.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"))).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def first_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, weighted: bool = False, crowd: int = CROWD) -> DataFrame:
    """The rows of df whose document is the first of its group; rows without id stay.

    Of rows that share an id but not the text, each stays or goes by its own text.
    """
    shared = ranks.own_ids(df, key, text)
    rows = shared[0] if shared else df
    found = _classes(rows, text, key, similarity, weighted, crowd).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = rows.join(found.hint("merge"), key, "left_anti").select(rows.columns)
    return ranks.with_ids(left, shared[1], key) if shared else left
