"""Operator 9: SimHash near-duplicates by a segment-popcount embedding.

Each fingerprint's 64 bits fall into 16 segments of 4; the bits set in each give a point in 16
dimensions. A bit that differs changes one coordinate by at most one, so the Manhattan distance of two
points is a lower bound of the Hamming distance of their fingerprints. The range join runs on the unit
grid: every fingerprint visits its own cell and the cells one step away, and two points within
distance 2 have a visited cell in common. Cells visited by one fingerprint alone fall away.

In the cells that are left the distance is verified exactly, without listing pairs: each visit stands
for the fingerprints that a single flip (or none) leads to in that cell, and two fingerprints differ in
at most two bits exactly if such a flip leads both to the same one. Each of these meeting points links
its visitors to the least of them, so dense groups cost as much as their members. Components of the
links come from alternating star contractions, each round written to the shared folder.

``one_of_each`` finds all pairs of texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or
more, which fingerprints can't: a tenth of a text replaced in one piece changes more bits than any radius that still
tells texts apart. A text is named by a digest of its words. Its shingles stand in one order for all texts, the common
ones last; as two such texts share at least 0.8 of either set, they share one of the first ones, up to
a fifth of the set and one more, and meet there. What is common is learned from a part of the texts; any
order finds all pairs, a better one lets fewer others meet. First each visitor of a meeting point is
compared with a leader of about its size and the one before it, by the texts themselves; then all of
different components that their sizes, places and sketches allow, so that each pair of a meeting point is linked,
connected already or ruled out. Copies that the first links connect cost as much as their members; pairs of
a group that stay just below the likeness are compared one by one.

Null texts count as empty; texts without words have fingerprint 0 and link like any other. In ``near_duplicates`` rows with
equal doc_id are one node for ids, each with its own fingerprint; component_id is the least non-null
doc_id of a component. ``one_of_each`` tells rows apart by doc_id and text: unlike texts of one id, and texts without an id, stay.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import delete
from .common import gathered, kept_folders, map_rows, texts
from .common import stored as stored_as_is

SEGMENTS, SEGMENT_BITS = 16, 4
BLOCK = 1 << 16
SEED = 42
MOST_ROUNDS = 60
#: What the texts of a link in ``one_of_each`` must have in common.
LIKE_WORDS, LIKENESS = 5, 0.8
#: Fingerprints that more than one in so many rows have are joined by broadcast: there are fewer than so many.
HOT_SHARE = 200
#: Links of one fingerprint are spread over so many keys.
SALTS = 64
#: Shingles that stand last in the order: of every so many texts, those that so many have, the most common ones up to a fixed number.
ORDER_OF, COMMON_IN, MOST_COMMON = 8, 3, 500_000
#: Words of 64 bits of a text's sketch: of each bit, whether an odd number of its shingles falls on it.
SKETCH = 4
SKETCH_NAMES = [f"sketch_{i}" for i in range(SKETCH)]
#: Names of rows that go which are sent to all tasks; more meet the texts by a shuffle.
MOST_GONE = 500_000
#: Meeting points with more visitors are compared by arrays.
FEW = 8


def stored(df: DataFrame) -> DataFrame:
    """A table between jobs, of at most eight files for a core: most of them hold a number or a few for each text."""
    return stored_as_is(gathered(df, 8))


def shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    hash_ = xxhash.xxh64_intdigest
    return [hash_(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def majority_fingerprint(text: str, width: int) -> int:
    """Bits that more than half of the shingles' hashes have, repeats included."""
    return majority(np.array(shingle_hashes(text, width), dtype=np.uint64))


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([majority_fingerprint(t, width) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "fp"])

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint")


def visits(prints: DataFrame) -> DataFrame:
    """fp, cell, hubs: the cells that each fingerprint visits, and what is within one flip of it in that cell."""
    popcounts = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))) for i in range(SEGMENTS)]
    step = [(SEGMENT_BITS + 1) ** i for i in range(SEGMENTS)]
    cell = sum((p.cast("long") * step[i] for i, p in enumerate(popcounts)), F.lit(0).cast("long"))

    def flips(i: int, up: bool):
        masks = [1 << (SEGMENT_BITS * i + j) for j in range(SEGMENT_BITS)]
        signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
        own = F.filter(signed, lambda m: (F.col("fp").bitwiseAND(m) == 0) if up else (F.col("fp").bitwiseAND(m) != 0))
        return F.struct((F.col("cell") + (step[i] if up else -step[i])).alias("cell"), F.transform(own, lambda m: F.col("fp").bitwiseXOR(m)).alias("hubs"))

    around = F.array(F.struct(F.col("cell"), F.array(F.col("fp")).alias("hubs")), *[flips(i, up) for i in range(SEGMENTS) for up in (True, False)])
    return prints.select("fp", cell.alias("cell")).select("fp", F.explode(around).alias("v")).select("fp", "v.cell", "v.hubs").where(F.size("hubs") > 0)


def links(prints: DataFrame) -> DataFrame:
    """u, v with u > v: links that connect what fingerprints at most two bits apart connect. prints: distinct fp."""
    own = visits(prints)
    shared = own.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("cell")
    # the number of shared cells grows with the input: no broadcast, at any size
    met = stored(own.join(shared.hint("merge"), "cell", "left_semi").select("fp", F.explode("hubs").alias("hub")))
    least = met.groupBy("hub").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select("hub", "v")
    return met.join(least, "hub").where("fp > v").select(F.col("fp").alias("u"), "v").distinct()


def holding(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """The links (u, v) whose texts share enough shingles of ``LIKE_WORDS`` words. bodies: fp, text."""

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = lambda t: np.unique(np.array(shingle_hashes(t, LIKE_WORDS), np.uint64))
        last, held, keep = None, None, []
        for a, b in zip(texts(batch, "a"), texts(batch, "b")):
            if b != last:
                last, held = b, sets(b)
            one = sets(a)
            both = len(np.intersect1d(one, held, assume_unique=True))
            keep.append(both > 0 and both >= LIKENESS * (len(one) + len(held) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    salted = edges.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    left = salted.join(bodies.select(F.col("fp").alias("u"), F.col("text").alias("a")), "u")
    right = salted.select("v", "salt").distinct().join(bodies.select(F.col("fp").alias("v"), F.col("text").alias("b")), "v")
    return map_rows(left.join(right, ["v", "salt"]).select("u", "v", "a", "b"), judged, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (u, v) and the least node it is connected to.

    Large and small stars in turn: first every node's greater neighbours, then its smaller ones, are
    linked to the least node around it, until nothing changes.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component_id of every fingerprint. distinct: fp and the least doc_id that has it."""
    roots = stored(components(edges))
    ids = roots.join(distinct, roots["node"] == distinct["fp"])
    by_root = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = ids.join(by_root, "root").select(F.col("node").alias("fp"), "component_id")
    return distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document; shingles have ``width`` words."""
    prints = stored(with_fingerprints(docs, width))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    known = stored(classes(distinct, links(distinct.select("fp"))))
    # Fingerprints of many rows go to these, the others meet theirs by a shuffle.
    hot = F.broadcast(known.where(F.col("n") > prints.count() // HOT_SHARE + 1).drop("n"))
    joined = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(known.drop("n"), "fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_class(docs: DataFrame, width: int) -> DataFrame:
    """The documents without those whose fingerprints link them to another: of each class of fingerprints, as ``near_duplicates`` has them, the row with the least doc_id (null last). Rows of equal doc_id and text stay or go together.

    Only names and fingerprints are written; the texts stay where they are.
    """
    spark, before = docs.sparkSession, len(kept_folders)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    named = docs.select(F.struct(F.col("doc_id").alias("id"), key.alias("key")).alias("doc_id"), "text")
    prints = stored(with_fingerprints(named, width).select("fp", "doc_id.*"))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("least")
    distinct = stored(prints.groupBy("fp").agg(least, F.count("*").alias("n")))
    kept = classes(distinct, links(distinct.select("fp"))).select("component_id.id", "component_id.key").distinct()
    same = lambda a, b: (a["key"] == b["key"]) & a["id"].eqNullSafe(b["id"])
    rows = prints.select("id", "key").distinct()
    gone = stored(rows.join(kept, same(rows, kept), "left_anti"))
    delete(spark, kept_folders[before:-1])
    del kept_folders[before:-1]
    found = gone.select(F.col("id").alias("__id"), F.col("key").alias("__key"))
    if found.count() <= MOST_GONE:
        found = F.broadcast(found)
    return docs.join(found, (key == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def digest(text: str) -> bytes:
    """What names a text: its words, but for case and white space."""
    return hashlib.sha256(b" ".join(text.encode().lower().split())).digest()


def with_digests(docs: DataFrame, *more: str) -> DataFrame:
    """key, doc_id, digest and, if asked for, the text. docs: key, doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = texts(batch)
        columns = [batch.column(0), batch.column(1), pa.array([digest(t) for t in own], pa.binary())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.string())] * len(more), ["key", "doc_id", "digest", *more])

    return map_rows(docs.select("key", "doc_id", "text"), run, ", ".join(["key bigint", f"doc_id {kind}", "digest binary", *[f"{m} string" for m in more]]))


def common_shingles(docs: DataFrame, distinct: DataFrame) -> np.ndarray:
    """Hashes of the shingles that stand last in the order, the most common one at the end."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(np.array(shingle_hashes(t, LIKE_WORDS), np.uint64)) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))], ["h"])

    some = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(ORDER_OF)) == 0).select("key")
    counts = map_rows(docs.select("key", "text").join(some, "key", "left_semi").select("text"), run, "h bigint").groupBy("h").count()
    found = counts.where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow()
    return found.column(0).to_numpy()[::-1].view(np.uint64).copy()


def first_shingles(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """key, digest, n (shingles of the text), the first of them in the order, one of which it shares with each text like it, and its sketch."""
    by_hash = np.argsort(common)
    known, ranks = common[by_hash], by_hash + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, sizes, firsts, sketches = texts(batch), [], [], []
        for t in own:
            hashes = np.unique(np.array(shingle_hashes(t, LIKE_WORDS), np.uint64))
            n = len(hashes)
            odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) % 2
            sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            if n and len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hashes = hashes[np.argsort(np.where(known[at] == hashes, ranks[at], 0), kind="stable")]
            sizes.append(n)
            firsts.append(hashes[: n - ceil(LIKENESS * n - 1e-6) + 1].view(np.int64))
        columns = [batch.column(0), pa.array([digest(t) for t in own], pa.binary()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
        columns += [pa.array([x[i] for x in sketches], pa.int64()) for i in range(SKETCH)]
        return pa.RecordBatch.from_arrays(columns, ["key", "digest", "n", "firsts", *SKETCH_NAMES])

    return map_rows(docs.select("key", "text"), run, "key bigint, digest binary, n int, firsts array<bigint>, " + ", ".join(f"{x} bigint" for x in SKETCH_NAMES))


def by_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The rows of each hub (the first column) that has two at least, as arrays of the other columns. Sorted by hub."""
    held: list[list[np.ndarray]] = []  # of the last hub so far

    def joined() -> list[np.ndarray]:
        return held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held)]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hubs, *rest = (batch.column(i).to_numpy() for i in range(batch.num_columns))
        cuts = [0, *(np.flatnonzero(hubs[1:] != hubs[:-1]) + 1).tolist(), len(hubs)]
        if held and hubs[0] != last:
            if sum(len(x[0]) for x in held) > 1:
                yield joined()
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            if held:
                held.append([x[a:b] for x in rest])
                yield joined()
                held = []
            elif b - a > 1:
                yield [x[a:b] for x in rest]
        held.append([x[cuts[-2] :].copy() for x in rest])
        last = hubs[-1]
    if held and sum(len(x[0]) for x in held) > 1:
        yield joined()


def could_be_like(n, at, m, place):
    """Whether texts of n and m shingles that share first those at ``at`` and ``place`` of the order can be alike."""
    return (np.minimum(n - at, m - place) >= LIKENESS / (1 + LIKENESS) * (n + m) - 1e-6) & (np.minimum(n, m) >= LIKENESS * np.maximum(n, m) - 1e-6)


def differ_little(n, sketch, m, other):
    """Whether texts of n and m shingles can be alike by their sketches: each bit that differs is a shingle of one alone."""
    return sum(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) for a, b in zip(sketch, other)) <= (1 - LIKENESS) / (1 + LIKENESS) * (n + m) + 1e-6


def compared(met: DataFrame, all_pairs: bool) -> DataFrame:
    """u, v with u > v: nodes that meet and could be alike, each with a leader and the one before it, or all of different
    components. met: hub, n, node, at and, for all pairs, root and sketch."""
    names = ["hub", "n", "node", "at", *(["root", *SKETCH_NAMES] if all_pairs else [])]

    def pairs(hubs: Iterator[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n, node, at, *more in hubs:
            if all_pairs:
                root, *sketch = more
                if (root == root[0]).all():
                    continue
                if len(n) <= FEW:
                    one, other = np.tril_indices(len(n), -1)
                    chosen = (root[one] != root[other]) & could_be_like(n[one], at[one], n[other], at[other])
                    chosen &= differ_little(n[one], [x[one] for x in sketch], n[other], [x[other] for x in sketch])
                    yield node[one[chosen]], node[other[chosen]]
                    continue
                lows = np.searchsorted(n, LIKENESS * n - 1e-6)
                for i, low in enumerate(lows.tolist()):
                    chosen = np.flatnonzero((root[low:i] != root[i]) & could_be_like(n[i], at[i], n[low:i], at[low:i])) + low
                    chosen = chosen[differ_little(n[i], [x[i] for x in sketch], n[chosen], [x[chosen] for x in sketch])]
                    yield np.full(len(chosen), node[i]), node[chosen]
            else:
                lead, leaders = 0, np.zeros(len(n), np.int64)
                for i, size in enumerate(n.tolist()):
                    if n[lead] < LIKENESS * size - 1e-6:
                        lead = i
                    leaders[i] = lead
                for one, other in ((np.arange(len(n)), leaders), (np.arange(1, len(n)), np.arange(len(n) - 1))):
                    chosen = (node[one] != node[other]) & could_be_like(n[one], at[one], n[other], at[other])
                    yield node[one[chosen]], node[other[chosen]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        for u, v in pairs(by_hub(batches)):
            us.append(np.maximum(u, v))
            vs.append(np.minimum(u, v))
            held += len(u) + 1
            if held >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs, held = [], [], 0
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    met = met.select(*names).repartition("hub").sortWithinPartitions("hub", "n", "node")
    return met.mapInArrow(run, "u bigint, v bigint").distinct()


def likenesses(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """u, v with u > v: links of nodes that connect what texts alike connect. docs: key, text; distinct: node, digest, key (of a row that has the text)."""
    named = distinct.select("node", "digest", "key")
    firsts = stored(first_shingles(docs, common_shingles(docs, distinct)).join(named, ["key", "digest"]).select("node", "n", "firsts", *SKETCH_NAMES).dropDuplicates(["node"]))
    met = firsts.select("node", "n", F.posexplode("firsts").alias("at", "hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for columns in by_hub(pa.RecordBatch.from_arrays([b.column(0), *b.columns], ["key", *b.schema.names]) for b in batches):
            held.append(columns)
            size += len(columns[0])
            if size >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["hub", "n", "node", "at"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["hub", "n", "node", "at"])

    met = met.select("hub", "n", "node", "at").repartition("hub").sortWithinPartitions("hub").mapInArrow(run, "hub bigint, n int, node bigint, at int")
    met = stored(met)

    def verified(edges: DataFrame) -> DataFrame:
        linked = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(named, "node")
        own = docs.join(linked.select("key"), "key", "left_semi")
        bodies = with_digests(own, "text").join(linked, ["key", "digest"]).groupBy("node").agg(F.min("text").alias("text"))
        return stored(holding(edges, stored(bodies.select(F.col("node").alias("fp"), "text"))))

    tried = stored(compared(met, False))
    held = verified(tried)
    roots = stored(components(held))
    # a hub's visitors that are connected already need no comparison
    known = firsts.select("node", *SKETCH_NAMES).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = met.join(known, "node")
    rest = stored(compared(met, True).join(tried, ["u", "v"], "left_anti"))
    return held.unionByName(verified(rest))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without their near-duplicates: of each class the one with the least doc_id (null last), of rows with equal doc_id and text one.

    A class joins texts of equal words and texts that ``likenesses`` links.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    prints = with_digests(keyed)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("least")
    distinct = stored(prints.groupBy("digest").agg(least).select("digest", "least", "least.key", F.monotonically_increasing_id().alias("node")))
    roots = stored(components(likenesses(keyed, distinct)))
    rooted = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = stored(rooted.agg(F.min("least").alias("least")).select(F.col("least.key").alias("__key"), F.col("least.doc_id").alias("__doc_id")))
    hashed = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    # Equal rows are folded before they move; what tells rows apart are doc_id and a digest of the text, the short key only names them.
    same = [key.alias("__key"), F.col("doc_id").alias("__id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__text")]
    own = docs.groupBy(*same).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("__row"))
    return own.join(kept, (own["__key"] == kept["__key"]) & own["__id"].eqNullSafe(kept["__doc_id"]), "left_semi").select("__row.*")
