"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, transitively.

1. Distinct texts, named by a hash, have a SimHash fingerprint of their shingles, WORDS words of 64 bits. The vantage-point trees of simhash.py link
   those at most RADIUS bits apart: a pair at the least similarity differs in 39 +- 6 bits, unlike ones in 128 +- 8. It shares no tree in
   about three of a million cases. Components of these links are the sets inside which near copies can be.
2. Shingle sets are compared exactly inside each such set. One of more than CELL texts is dealt to cells by name, each with the
   same PIVOTS texts, so a dense group becomes one whatever its size; then what lies outside the largest group of its set is
   compared with every text of the set that it isn't grouped with, cell by cell.

Links span groups, never all pairs. No link or text comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import Shelf, partitions, text_or_empty
from rangeloom.llm.decontam import WordHashes
from rangeloom.llm.simhash import WIDE_MEAN, WORDS, classes_of, components, links as tree_links, wide_fingerprint

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 72
CELL, PIVOTS = 400, 16
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of hashed words, sorted; all words are one if they are fewer, no words have none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = (out ^ words[j : j + n]) * _MUL
        out ^= out >> np.uint64(29)
    return np.unique(out)


def spanning_links(sets: list[np.ndarray], roots: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between similar sets, enough to span every group; sets with equal roots are together already."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    unique, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner, mark = np.repeat(np.arange(n), sizes), np.zeros(len(unique), bool)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    left, links = np.ones(n, bool), []
    for first in range(n):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            i = queue.pop()
            mine = place[ends[i] : ends[i + 1]]
            mark[mine] = True
            both = np.bincount(owner[mark[place]], minlength=n)
            mark[mine] = False
            near = left & ((roots == roots[i]) | (both >= similarity * (sizes + sizes[i] - both) - 1e-9))
            got = np.flatnonzero(near).tolist()
            links += [(i, j) for j in got if roots[i] != roots[j]]
            queue += got
            left[near] = False
    return links


def _compare(cells: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links of the cells of (cell, name, root, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def found(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
            names, pairs = list(held), []
            if len(held) > 1:
                pairs = spanning_links([s for _, s in held.values()], np.array([r for r, _ in held.values()]), similarity)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.int64()), pa.array([names[j] for _, j in pairs], pa.int64())], ["a", "b"])

        now, held = None, {}
        for batch in batches:
            for cell, name, root, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if cell != now:
                    if held:
                        yield found(held)
                    now, held = cell, {}
                if name not in held:
                    held[name] = (root, shingles(hashes.of(text.as_py()), width))
        if held:
            yield found(held)

    return cells.repartition(partitions(cells.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, cell: int = CELL, shelf: Shelf | None = None, mean: int = WIDE_MEAN) -> DataFrame:
    """(id, component_id) for each row: the smallest id of its group.

    Texts without words, null ones too, are one group. Repeated rows share a group; a null id is never the smallest. An
    empty table gives an empty table; other columns are not read.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("name", F.xxhash64("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            got = [wide_fingerprint(shingles(hashes.of(x.as_py()), width)) for x in batch.column(1)]
            flat = np.array(got, np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(flat[:, k]) for k in range(WORDS))], ["name", *words])

    words = [f"word{k}" for k in range(WORDS)]
    rows = shelf.keep(texts.select("name", "text").mapInArrow(sketch, "name long, " + ", ".join(f"{w} long" for w in words)).distinct())
    prints = shelf.keep(rows.groupBy(*words).agg(F.min("name").alias("fp")))
    alike = rows.join(prints, words).where("name <> fp").select(F.col("name").alias("a"), F.col("fp").alias("b"))
    sets = components(tree_links(prints, RADIUS, shelf=shelf, mean=mean).unionByName(alike).distinct(), shelf)
    sets = shelf.keep(sets.unionByName(sets.select(F.col("root").alias("node"), "root")).distinct().toDF("name", "set"))
    shelf.drop(rows)
    shelf.drop(prints)
    spread = sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    # Copies are combined before the shuffle, which the join shares.
    once = texts.groupBy("name").agg(F.min("text").alias("text"))
    member = once.join(sets, "name").join(spread, "set")
    member = shelf.keep(member.withColumn("cells", F.ceil(F.col("n") / cell)).withColumn("home", F.pmod(F.xxhash64("name"), F.col("cells"))))
    pivot = F.pmod(F.hash("name"), F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS))) == 0
    dealt = member.withColumn("at", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).otherwise(F.array("home"))))
    links = shelf.keep(_compare(dealt.select(F.xxhash64("set", "at").alias("cell"), "name", F.col("name").alias("root"), "text"), width, similarity))
    groups = components(links, shelf)

    # Sets of several cells: what is outside the largest group against all of the set.
    rooted = member.where("cells > 1").join(groups, member["name"] == groups["node"], "left").select("set", "name", "text", "cells", "home", F.coalesce("root", "name").alias("root"))
    rooted = shelf.keep(rooted)
    counted = rooted.groupBy("set", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("set").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"))
    open_sets = counted.select("set", F.col("top.root").alias("largest"), F.ceil((F.col("all") - F.col("top.n")) / cell).alias("tiles")).where("tiles > 0")
    if not open_sets.isEmpty():
        met = rooted.join(open_sets, "set").withColumn("tile", F.pmod(F.hash("name"), F.col("tiles")))
        every = met.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        outside = met.where("root <> largest").withColumn("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
        columns = [F.xxhash64("set", F.col("tile").cast("long"), "home").alias("cell"), "name", "root", "text"]
        more = _compare(every.select(*columns).unionByName(outside.select(*columns)), width, similarity)
        groups = components(links.unionByName(more), shelf)
    ids = texts.groupBy("name").agg(F.min("id").alias("least"))
    named = ids.join(groups, ids["name"] == groups["node"], "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    return texts.select("id", "name").join(classes_of(named, "name", "least"), "name").select(F.col("id").alias(id_col), "component_id")
