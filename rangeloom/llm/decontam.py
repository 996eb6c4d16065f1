"""Benchmark decontamination with spaced seeds.

Fixed masks pick some of the words of a short window and ignore the others, so a seed still hits where an ignored word was
substituted. The benchmark's seeds are looked up in each document's seeds; around every hit the two texts are laid word by
word against each other. They overlap if any stretch of LEAST_WORDS words or more agrees in at least `agreement` of its words; an
item shorter than that, if the words that agree anywhere along the item are that share of it.

A stretch of 26 words or more that agrees in four fifths has a half of 13 words or more that does, and the masks hit every way
to place the misses in 13 to 25 words and in items of 4 to 12 words, those of five words with two masks of their own. Where
`agreement` is set lower, the seeds may miss some.

The benchmark is the small side and goes to the tasks in slices of at most SLICE_BYTES of text; each slice is one more
pass over the documents, so the broadcast has a proven bound for a benchmark of any size. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rangeloom.llm.common import table, text_or_empty

MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 4, 6))
#: Masks only for items of so many words.
MASKS_OF = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 5: ((0, 2, 3, 4), (0, 1, 2, 4))}
LEAST_WORDS = 13
AGREEMENT = 0.8
SLICE_BYTES = 2 << 20
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class WordHashes:
    """64-bit hashes of lower-cased words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def of(self, text: str) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known, words = self.known, text.encode().lower().split()
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxh64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the masked words at each place where the whole mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, off in enumerate(mask):
        out = (out ^ (words[off : off + n] * _MUL[k])) * _MUL[(k + 1) % 4]
        out ^= out >> np.uint64(29)
    return out ^ np.uint64(sum(mask) + 64 * len(mask))


class SeedIndex:
    """The seeds of one benchmark slice: sorted hashes behind a bitmap, with the places they come from."""

    def __init__(self, items: list[tuple[object, str]]):
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashes.of(t) for _, t in items]
        self.masks = [*MASKS, *(m for n in sorted({len(w) for w in self.words}) for m in MASKS_OF.get(n, ()))]
        keys, places = [], []
        for i, w in enumerate(self.words):
            for mask in (*MASKS, *MASKS_OF.get(len(w), ())):
                s = seeds(w, mask)
                keys.append(s)
                places.append(np.stack([np.full(len(s), i), np.arange(len(s))], 1))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.place = (np.concatenate(places) if places else np.zeros((0, 2), np.int64))[order]
        # Eight places a seed at least: about one in eight of a document's seeds passes by chance, and is looked up.
        bits = max(20, int(8 * len(self.key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(self.key >> self.shift).astype(np.int64)] = True

    def hits(self, doc: np.ndarray) -> dict[tuple[int, int], int]:
        """(item, diagonal) -> number of seeds; the diagonal is the document's place minus the item's."""
        out: dict[tuple[int, int], int] = {}
        for mask in self.masks:
            s = seeds(doc, mask)
            at = np.flatnonzero(self.bitmap[(s >> self.shift).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.key, s[at], "left"), np.searchsorted(self.key, s[at], "right")
            for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist()):
                for i, j in self.place[a:b].tolist():
                    out[i, p - j] = out.get((i, p - j), 0) + 1
        return out


def best_stretch(same: np.ndarray, least: int = LEAST_WORDS, agreement: float = AGREEMENT) -> tuple[int, int, int] | None:
    """(start, end, agreeing words) of the best stretch of at least `least` words that agrees in that share; None if none does.

    The best has the largest sum of 1 - share for a match and -share for a miss, which is not negative if and only if the
    stretch agrees enough; ties go to the earlier end, then to the shorter stretch.
    """
    if len(same) < least or not least:
        return None
    share = agreement - 1e-9
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - share, -share))])
    starts = score[: len(score) - least]
    gain = score[least:] - np.minimum.accumulate(starts)
    k = int(np.argmax(gain))
    if gain[k] < 0:
        return None
    end = k + least
    start = k - int(np.argmin(starts[k::-1]))
    return start, end, int(same[start:end].sum())


def overlap(same: np.ndarray, item_words: int, least: int = LEAST_WORDS, agreement: float = AGREEMENT) -> tuple[int, int, int] | None:
    """(start, end, agreeing words) of the overlap on a diagonal where `same` says which words agree; None if it is too little."""
    if item_words >= least:
        return best_stretch(same, least, agreement)
    n = int(same.sum())
    if n < (agreement * item_words - 1e-9 if item_words >= 4 else item_words) or not n:
        return None
    at = np.flatnonzero(same)
    return int(at[0]), int(at[-1]) + 1, n


def overlaps(index: SeedIndex, doc: np.ndarray, least: int, agreement: float) -> Iterator[tuple[int, tuple[int, int, int, int, int]]]:
    """(item's place in the index, (seeds, words, agreeing words, start in doc, start in item)) of each diagonal that overlaps."""
    for (i, diagonal), n in index.hits(doc).items():
        item = index.words[i]
        a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        found = overlap(item[a:b] == doc[a + diagonal : b + diagonal], len(item), least, agreement)
        if found is not None:
            start, end, same = found
            yield i, (n, end - start, same, a + start + diagonal, a + start)


def slices_of(benchmark: DataFrame, item_col: str, item_text: str, slice_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's (item, text) in slices of about slice_bytes of text."""
    items = benchmark.select(F.col(item_col).alias("i"), text_or_empty(item_text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    slices = max(1, -(-int(total) // slice_bytes))
    for k in range(slices):
        yield [tuple(r) for r in (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k) if slices > 1 else items).collect()]


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    least_words: int = LEAST_WORDS, agreement: float = AGREEMENT, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(id, item, n_seeds, n_words, n_same, doc_start, item_start) for each document and item that overlap, the best place of each.

    An item shorter than least_words counts if the document holds all its words but the share that may differ; one of
    fewer than four words only if they all agree. A null or empty text, document or item, has no words and overlaps nothing.
    Repeated rows give repeated rows, repeated items too; null ids are carried, item ids are of any type; a very long text is searched
    whole; an empty table on either side gives an empty table, other columns are not read. Ties go to more agreeing words,
    then to the earlier place.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"id {kinds[0]}, item {kinds[1]}, n_seeds long, n_words long, n_same long, doc_start long, item_start long"
    arrow_item = to_arrow_type(benchmark.schema[item_col].dataType)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = None
    for mine in slices_of(benchmark, item_col, item_text, slice_bytes):
        shared = spark.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = SeedIndex(shared.value), WordHashes()
            for batch in batches:
                rows = []
                for at, text in enumerate(batch.column(1)):
                    best: dict[int, tuple] = {}
                    for i, found in overlaps(index, hashes.of(text.as_py()), least_words, agreement):
                        if i not in best or (found[2], -found[3]) > (best[i][2], -best[i][3]):
                            best[i] = found
                    rows += [(at, index.ids[i], *v) for i, v in sorted(best.items())]
                cols = list(zip(*rows)) if rows else [[]] * 7
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], arrow_item), *(pa.array(c, pa.int64()) for c in cols[2:])], ["id", "item", "n_seeds", "n_words", "n_same", "doc_start", "item_start"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col} if id_col != item_col else {"id": id_col})


def without_overlaps(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    least_words: int = LEAST_WORDS, agreement: float = AGREEMENT, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The rows of docs that hold no item, each by its own text, whatever its id; all columns stay.

    An item of fewer than four words ('yes') is no passage: it takes a row only if it is the whole text. All other overlaps that
    find_overlaps() reports take theirs.
    """
    at, out = docs.columns.index(text_col), docs
    for mine in slices_of(benchmark, item_col, item_text, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = SeedIndex(shared.value), WordHashes()
            for batch in batches:
                kept = []
                for text in batch.column(at):
                    doc = hashes.of(text.as_py() or "")
                    kept.append(not any(len(index.words[i]) >= 4 or len(index.words[i]) == len(doc) for i, _ in overlaps(index, doc, least_words, agreement)))
                yield batch.filter(pa.array(kept, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
