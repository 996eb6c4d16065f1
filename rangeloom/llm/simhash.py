"""SimHash near-dedup: 64-bit fingerprints of four-word shingles, linked at four or fewer differing bits.

Exact pairs come from a forest of vantage-point trees. In the distance over all 64 bits a split by a vantage point shrinks nothing at
this radius: distances of unlike fingerprints crowd around 32 +- 4, so nearly all of them overlap a border (README has figures). So
each tree measures distance over some of the bits only. The bits are cut into blocks; a pair at most `radius` apart differs in at most
`radius` of them, so in some tree, of the blocks that remain, its distance is zero and by the triangle bound it is at one distance
from any vantage point: no pair straddles a border there, and the shards are the places of a tree's bits. There are more and narrower blocks
for more fingerprints, so that a shard of unlike ones stays at about SHARD_MEAN at any size.

A shard of more than SHARD_ROWS holds like ones. It is dealt to cells that all get the same few vantage points, which bring a
dense group together from any number of cells; what lies outside the shard's largest group is then compared with all of the
shard, cell by cell. Inside a cell, candidates are pruned by the triangle bound around two vantage points over all bits, and links that
span its groups are emitted, never all pairs, so a group of n copies costs n links.

Everything runs over distinct fingerprints: copies were merged to (fingerprint, smallest doc_id) before any shuffle by
shard. Components are found by alternating large-star and small-star steps over the links, each written to the shared
folder; no fingerprint, link or component comes to the driver.

Near copies by shingle sets (nearcopies.py) take the same trees over fingerprints of WORDS words: at similarity 0.8 a bit differs with chance FLIPS, too
often for blocks. There a tree looks at some bits drawn at random, and there are so many trees that a pair is equal on those of none in MISS cases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import Shelf, partitions, table, text_or_empty

RADIUS = 4
SHARD_MEAN = 1_000
SHARD_ROWS = 20_000
VANTAGES = 16
#: Into how many parts the rows of one node are dealt where stars are joined.
SALTS = 8
#: Wide fingerprints: words of 64 bits, unlike ones a shard, the chance that a bit of a pair at Jaccard similarity 0.8 differs, and that no tree has the pair.
WORDS = 4
WIDE_MEAN = 4_000
FLIPS = math.acos(0.8 * 2 / 1.8) / math.pi
MISS = 3e-6
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, WORDS, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64 bits, signed: a bit is set if more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.encode().split()
    if not words:
        return 0
    # bytes.lower() and bytes.split() know exactly A-Z and the six white-space characters.
    joined = b" ".join(words).lower()
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        edges = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(edges[: len(words) - width] + 1).tolist()]
        ends = [*edges[width - 1 :].tolist(), len(joined)]
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits from the sorted distinct hashes of a set; the least decides where half have a bit. Zeros for an empty set."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    ones = 0
    for at in range(0, len(hashes), 1 << 14):
        mixed = (hashes[at : at + (1 << 14), None] ^ _SEEDS) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        ones = (ones if at else bits[0].astype(np.int64)) + 2 * bits.sum(0, dtype=np.int64)
    return np.packbits(ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each row; zero for a null or empty text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _few_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]] | None:
    """Links between wide fingerprints from all pairs, some rows at a time; None if there are too many pairs to list."""
    n, words, groups, links, seen = len(fps), np.ascontiguousarray(fps.T), Groups(len(fps)), [], 0
    for lo in range(0, n, 64):
        d = np.zeros((len(fps[lo : lo + 64]), n - lo), np.uint16)
        for w in words:
            d += np.bitwise_count(w[lo : lo + 64, None] ^ w[None, lo:])
        a, b = np.nonzero(d <= radius)
        a, b = a[a < b], b[a < b]
        seen += len(a)
        if seen > 16 * n:
            return None
        links += [(i, j) for i, j in zip((a + lo).tolist(), (b + lo).tolist()) if groups.join(i, j)]
    return links


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between fingerprints (unsigned, distinct; wide ones are rows of words) at most radius apart, enough to span every group.

    Small sets are compared in whole. A larger one is sorted by distance from a vantage point; each point then looks only
    at the unvisited ones whose distance from it is within the radius, by two vantage points, so a dense group melts
    away as it is walked.
    """
    n, wide = len(fps), fps.ndim == 2
    if n < 2:
        return []
    if wide and (links := _few_links(fps, radius)) is not None:
        return links
    if n <= 256 and not wide:
        a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
        near = a < b
        groups = Groups(n)
        return [(i, j) for i, j in zip(a[near].tolist(), b[near].tolist()) if groups.join(i, j)]
    apart = lambda a, b: np.bitwise_count(a ^ b).sum(-1, dtype=np.int16) if wide else np.bitwise_count(a ^ b)
    first = apart(fps, fps[0]).astype(np.int16)
    second = apart(fps, fps[int(first.argmax())]).astype(np.int16)
    order = np.lexsort((second, first))
    rest_f, rest_1, rest_2, rest_i = fps[order], first[order], second[order], order
    links: list[tuple[int, int]] = []
    while len(rest_i):
        queue = [(int(rest_i[0]), rest_f[0], int(rest_1[0]), int(rest_2[0]))]
        rest_f, rest_1, rest_2, rest_i = rest_f[1:], rest_1[1:], rest_2[1:], rest_i[1:]
        while queue and len(rest_i):
            i, f, d1, d2 = queue.pop()
            lo, hi = np.searchsorted(rest_1, [d1 - radius, d1 + radius + 1])
            may = lo + np.flatnonzero(np.abs(rest_2[lo:hi] - d2) <= radius)
            got = may[apart(rest_f[may], f) <= radius]
            if len(got):
                links += [(i, int(j)) for j in rest_i[got]]
                queue += list(zip(rest_i[got].tolist(), rest_f[got], rest_1[got].tolist(), rest_2[got].tolist()))
                left = np.ones(len(rest_i), bool)
                left[got] = False
                rest_f, rest_1, rest_2, rest_i = rest_f[left], rest_1[left], rest_2[left], rest_i[left]
    return links


def masks(n: int, radius: int = RADIUS, mean: int = SHARD_MEAN, bits: int = 64) -> list[int]:
    """The bits of each tree for n fingerprints: any pair at most radius bits apart is equal on all bits of one of them."""
    blocks = radius + 1
    while n > mean * 2 ** (bits * (blocks - radius) / blocks) and blocks < radius + 4:
        blocks += 1
    edges = [round(bits * k / blocks) for k in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(block, blocks - radius)]


def wide_masks(n: int, mean: int = WIDE_MEAN) -> list[list[int]]:
    """The bits of each tree, word by word, for n wide fingerprints: more bits for more of them, and more trees for more bits."""
    bits = max(0, math.ceil(math.log2(max(1, n) / mean)))
    if not bits:
        return [[0] * WORDS]
    trees, rng = math.ceil(math.log(MISS) / math.log1p(-((1 - FLIPS) ** bits))), np.random.default_rng(42)
    chosen = [rng.choice(64 * WORDS, bits, replace=False).tolist() for _ in range(trees)]
    return [[sum(1 << (x % 64) for x in tree if x // 64 == w) for w in range(WORDS)] for tree in chosen]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that span the groups inside each shard of (shard, fp), or of (shard, fp, words) with fp the name of wide fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray) -> pa.RecordBatch:
            names, first = np.unique(rows[:, 0], return_index=True)
            signed = names.view(np.int64)
            pairs = np.array(spanning_links(rows[first, 1:] if rows.shape[1] > 1 else names, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], ["a", "b"])

        key, held = None, []  # the shard that may go on in the next batch
        for batch in batches:
            shard, fps = batch.column(0).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], 1)
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(0, np.int64)
            if held and len(shard) and shard[0] != key:
                yield found(np.concatenate(held))
                held = []
            # Shards of one row, most of them, are passed over; the last may go on.
            for k in np.flatnonzero((np.diff(cuts) > 1) | (np.arange(len(cuts) - 1) == len(cuts) - 2) | ((np.arange(len(cuts) - 1) == 0) & bool(held))).tolist():
                lo, hi = cuts[k], cuts[k + 1]
                part = [*held, fps[lo:hi].copy()]
                held = []
                if k == len(cuts) - 2:
                    key, held = shard[lo], part
                else:
                    yield found(np.concatenate(part))
        if held:
            yield found(np.concatenate(held))

    return shards.repartition(partitions(shards.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, shelf: Shelf | None = None, mean: int = SHARD_MEAN) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` at most radius bits apart that span every group, exactly.

    With WORDS more columns `fp` is the name of the wide fingerprint in them, and pairs at similarity 0.8 are linked but for MISS of them.
    """
    shelf = shelf or Shelf(distinct.sparkSession)
    words = [c for c in distinct.columns if c != "fp"]
    named = ["fp", *words]
    bits = wide_masks(distinct.count(), mean) if words else [[m] for m in masks(distinct.count(), radius, mean)]
    of_tree = [F.xxhash64(F.lit(k), *[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(words or ["fp"], some)]) for k, some in enumerate(bits)]
    trees = distinct.select(F.explode(F.array(*of_tree)).alias("shard"), *named)
    large = shelf.keep(trees.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows))
    if large.isEmpty():
        return _linked(trees, radius)
    small = _linked(trees.join(large, "shard", "left_anti"), radius)
    cell = F.pmod(F.xxhash64("fp"), F.col("cells"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    member = shelf.keep(trees.join(large, "shard").withColumn("cells", F.ceil(F.col("n") / shard_rows)).withColumn("home", cell))
    vantage = F.pmod(F.hash("fp"), F.greatest(F.lit(1), F.floor(F.col("n") / VANTAGES))) == 0
    dealt = member.withColumn("at", F.explode(F.when(vantage, every(F.col("cells"))).otherwise(F.array("home"))))
    near = shelf.keep(_linked(dealt.select(F.xxhash64("shard", "at").alias("shard"), *named), radius))
    groups = components(near, shelf)
    rooted = shelf.keep(member.join(groups, member["fp"] == groups["node"], "left").select("shard", *named, "cells", "home", "n", F.coalesce("root", "fp").alias("root")))
    top = rooted.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("shard").agg(F.max(F.struct("k", "root")).alias("top"))
    met = rooted.join(top, "shard").withColumn("tiles", F.ceil((F.col("n") - F.col("top.k")) / shard_rows)).where("tiles > 0").withColumn("tile", F.pmod(F.hash("fp"), F.col("tiles")))
    inside = met.withColumn("tile", F.explode(every(F.col("tiles"))))
    outside = met.where(F.col("root") != F.col("top.root")).withColumn("home", F.explode(every(F.col("cells"))))
    columns = [F.xxhash64("shard", F.col("tile").cast("long"), "home").alias("shard"), *named]
    return small.union(near).union(_linked(inside.select(*columns).union(outside.select(*columns)).distinct(), radius)).distinct()


def components(edges: DataFrame, shelf: Shelf, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node of its component.

    Large-star and small-star in turn until nothing changes; each round is a written table of at most one row a link. A node's
    smallest neighbour is met in SALTS parts, so the rows of one node are no single task.
    """
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")

    def starred(rows: DataFrame, low: DataFrame) -> DataFrame:
        return rows.withColumn("salt", salt).join(low.select("*", salts), ["u", "salt"])

    def print_of(links: DataFrame) -> tuple:
        """What tells one set of links from another: their number and two independent sums of hashes, 128 bits."""
        sums = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2)]
        return tuple(links.agg(F.count(F.lit(1)), *sums).first())

    now = shelf.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = print_of(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = starred(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = starred(large, low2).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.toDF("u", "v")).distinct()
        new = shelf.keep(small)
        before, seen = seen, print_of(new)
        shelf.drop(now)
        now = new
        if before == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def classes_of(grouped: DataFrame, key: str, least: str) -> DataFrame:
    """(key, component_id): the smallest `least` of each root in (key, least, root); a root's rows are met in SALTS parts."""
    named = grouped.groupBy("root").agg(F.min(least).alias("component_id")).select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    return grouped.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(named, ["root", "salt"]).select(key, "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS, shelf: Shelf | None = None) -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id reachable over links of at most `radius` bits.

    A null or empty text has fingerprint zero and links like any other. Repeated rows share a fingerprint, so a
    component. A null id is never the smallest; a component of null ids only has a null component_id. An empty table
    gives an empty table; other columns are not read.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    of = shelf.keep(fingerprints(docs, id_col, text_col))
    distinct = of.groupBy("fp").agg(F.min("id").alias("least"))
    joined = components(links(distinct.select("fp"), radius, shard_rows, shelf), shelf)
    grouped = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return of.join(classes_of(grouped, "fp", "least"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
