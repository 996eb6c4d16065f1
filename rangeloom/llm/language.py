"""Language-model scoring by a probabilistic suffix tree over words, and the word baseline.

Tree. Symbols are a text's lower-cased words and its end. A state is a context of up to DEPTH words before a symbol (an opening mark
stands before the first). A context is looked at if the training texts hold it LEAST times or more, an absolute number, and its suffix is a
state; it keeps counts of the symbols that follow its suffix LEAST times or more, the others are one class whose probabilities are the
suffix's, scaled. It is retained if its next-symbol distribution diverges from the one that its suffix gives: the gain in log-likelihood
over all its occurrences must exceed GAIN for each symbol that it keeps. What is retained thus grows with the corpus, and no share of it is
cut off. Distributions are smoothed by absolute discounting with that of the suffix, down to the shares of single words; a symbol is scored
in the longest state that ends before it.

Plan. Texts are cut into batches of about BATCH_BYTES where they are read, each one row of word places, which is shuffled once and read
by all rounds; no text is. A level of the tree is one round: a batch asks about its distinct (context, next word) pairs by hash (packed, sorted), with what its training
texts add to their counts; a bucket's task sees all entries of a context, sums, tests, and answers each batch in the batch's own order.
The next round asks only below contexts that passed. No vocabulary, pair or state is collected or broadcast. A context with more than HOT
occurrences is dealt to buckets by its next words, so a word in a third of all places is no single task. What its parts count is summed up
without the words, by count and suffix probability, and brought together for the same test and the same smoothing as any other's, so how
contexts are dealt changes no score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import batches as B
from rangeloom.llm.common import partitions, table

DEPTH = 2
LEAST = 2
GAIN = 2.0
DISCOUNT = 0.75
HOT = 1 << 21
#: Only where a caller passes `hot`: the weight, in occurrences, of the suffix's distribution in that of a context with more.
HOT_WEIGHT = 1000.0
BATCH_BYTES = 12 << 20
#: Bytes of text whose questions a bucket gets, about.
BUCKET_BYTES = 8 << 20
#: The end of a text, as a word: no word holds a line break.
END = b"\n"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(body: bytes) -> list[bytes]:
    return body.lower().split()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _M2)) * _M1
    x ^= x >> np.uint64(31)
    x *= _M2
    return x ^ (x >> np.uint64(29))


def pack_counts(n: np.ndarray) -> bytes:
    """A byte each, and four more for those that don't fit one."""
    small = np.minimum(n, 255).astype(np.uint8)
    return small.tobytes() + n[small == 255].astype("<u4").tobytes()


def unpack_counts(blob: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n counts and where they end."""
    out = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(blob, "<u4", len(large), at + n)
    return out, at + n + 4 * len(large)


def planes(places: np.ndarray) -> bytes:
    """Places below 2**32, byte by byte: most are small, so most of the higher bytes are zero."""
    return zipped(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def zipped(blob: bytes) -> bytes:
    return np.int64(len(blob)).tobytes() + pa.compress(blob, "zstd", asbytes=True)


def unzipped(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def pack_keys(keys: np.ndarray, size: int, rising: bool = False) -> bytes:
    """The low bytes of each key, byte by byte; keys that mostly rise as their differences."""
    if rising and len(keys):
        keys = np.append(keys[:1], np.diff(keys))
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unpack_keys(blob: bytes, n: int, size: int, at: int, rising: bool = False) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8, size * n, at).reshape(size, n).T
    keys = out.view("<u8").ravel()
    return np.cumsum(keys, dtype=np.uint64) & np.uint64((1 << 8 * size) - 1) if rising else keys


def edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


class Batch:
    """One row of word places, and what the rounds say about each token."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray, buckets: int):
        self.words, self.tokens, self.sizes, self.buckets = words, tokens, sizes, buckets
        self.stop = np.cumsum(sizes)
        self.trained = np.repeat(~held, sizes)
        self.order = np.argsort(words, kind="stable")

    def word_question(self) -> dict[int, bytes]:
        keys = self.words[self.order]
        n = np.bincount(self.tokens[self.trained], minlength=len(keys))[self.order]
        return {b: zipped(pack_keys(keys[lo:hi], 5, True) + pack_counts(n[lo:hi])) for b, lo, hi in self._cut(keys)}

    def _cut(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of sorted keys."""
        where = B.bucket_of(keys, self.buckets)
        at = [*edges(where).tolist(), len(where)]
        return [(int(where[lo]), lo, hi) for lo, hi in zip(at, at[1:]) if hi > lo]

    def take_words(self, blobs: dict[int, bytes], total: int, kinds: int) -> None:
        """Word counts: the baseline's probabilities, and each token's first context."""
        keys = self.words[self.order]
        n = np.zeros(len(keys), np.int64)
        for b, lo, hi in self._cut(keys):
            n[lo:hi], _ = unpack_counts(unzipped(blobs[b]), hi - lo)
        self.count = np.zeros(len(keys), np.int64)
        self.count[self.order] = n
        self.base = np.log((self.count + 0.1) / (total + 0.1 * (kinds + 1)))  # by word
        self.log_p = self.base[self.tokens]
        hashes = self.words[self.tokens]
        first = self.stop - self.sizes
        ends = self.count[self.tokens[-1]] if len(self.tokens) else 0  # as many as there are beginnings
        self.context, self.occurs = np.roll(hashes, 1), np.roll(self.count[self.tokens], 1)
        self.context[first], self.occurs[first] = np.uint64(1), ends
        self.hashes, self.first = hashes, first
        self.below = self.count[self.tokens]  # how often the symbol follows the suffix of the context that is looked at
        self.retained = np.ones(len(hashes), bool)

    def ask(self, hot: int, fixed: bool) -> None:
        """Sorts the tokens whose context is looked at, by context; of those whose symbol it keeps, the pairs."""
        self.at = np.flatnonzero((self.occurs >= LEAST) & self.retained)
        n, w = self.occurs[self.at], self.hashes[self.at]
        self.is_hot = n > hot
        self.is_fixed = self.is_hot & fixed
        route = np.where(self.is_hot, mix(self.context[self.at], w % np.maximum(1, -(-n // hot)).astype(np.uint64) + np.uint64(7)), self.context[self.at])
        self.routes, first, self.route_of = np.unique(route, return_index=True, return_inverse=True)
        self.route_n = np.minimum(n[first], hot + 1)
        # The contexts of which a route is a part, and how often they occur.
        self.dealt, self.whole, self.whole_n = self.is_hot[first] & (not fixed), self.context[self.at][first], n[first]
        self.kept = np.flatnonzero((self.below[self.at] >= LEAST) | self.is_fixed)
        of, word = self.route_of[self.kept], w[self.kept] & np.uint64(0xFFFFFFFF)
        pairs, first, pair_of = np.unique((of.astype(np.uint64) << np.uint64(32)) | word, return_index=True, return_inverse=True)
        self.pair_of, self.pair_first, self.pair_words = pair_of, first, pairs & np.uint64(0xFFFFFFFF)
        self.pairs_from = np.searchsorted(pairs >> np.uint64(32), np.arange(len(self.routes) + 1, dtype=np.uint64))

    def question(self) -> dict[int, bytes]:
        tokens = self.at[self.kept]
        mine = self.trained[tokens]
        n = np.bincount(self.pair_of[mine], minlength=len(self.pair_words))
        # What the suffix says of each pair, in eighths of a natural logarithm.
        low = np.clip(np.rint(-8 * self.log_p[tokens[self.pair_first]]), 0, 255).astype(np.uint8)
        succ = np.diff(self.pairs_from)
        out = {}
        for b, lo, hi in self._cut(self.routes):
            p, q = self.pairs_from[lo], self.pairs_from[hi]
            out[b] = zipped(b"".join((np.array([hi - lo, q - p], "<i8").tobytes(), pack_keys(self.routes[lo:hi], 4, True), pack_counts(self.route_n[lo:hi]), pack_counts(succ[lo:hi]), pack_keys(self.pair_words[p:q], 4, True), low[p:q].tobytes(), pack_counts(n[p:q]), *(x[lo:hi][self.dealt[lo:hi]].astype("<u8").tobytes() for x in (self.whole, self.whole_n)))))
        return out

    def take(self, blobs: dict[int, bytes], verdicts: np.ndarray) -> None:
        """Counts of the pairs and the retained contexts: new probabilities, and the next level's contexts. verdicts: (context, told, rest) of those dealt."""
        n = np.zeros(len(self.pair_words), np.int64)
        told, rest = np.zeros(len(self.routes), np.int64), np.zeros(len(self.routes), np.int64)
        for b, lo, hi in self._cut(self.routes):
            p, q, blob = self.pairs_from[lo], self.pairs_from[hi], unzipped(blobs[b])
            told[lo:hi], at = unpack_counts(blob, int(hi - lo))
            rest[lo:hi], at = unpack_counts(blob, int(hi - lo), at)
            n[p:q], _ = unpack_counts(blob, int(q - p), at)
        if self.dealt.any():
            verdicts = verdicts[np.argsort(verdicts[:, 0])]
            at = np.searchsorted(verdicts[:, 0], self.whole[self.dealt])
            told[self.dealt], rest[self.dealt] = verdicts[at, 1:].astype(np.int64).T
        seen = np.zeros(len(self.at), np.int64)
        seen[self.kept] = n[self.pair_of]
        kinds, total = told[self.route_of], self.occurs[self.at]
        low, on = np.exp(self.log_p[self.at]), kinds > 0
        own = np.where(self.is_fixed, (seen + HOT_WEIGHT * low) / (total + HOT_WEIGHT), (np.maximum(seen - DISCOUNT, 0) + (rest[self.route_of] + DISCOUNT * (kinds - 1)) * low) / total)
        self.log_p[self.at[on]] = np.log(own[on])
        self.retained[:] = False
        self.retained[self.at[on]] = True
        self.below = np.zeros(len(self.hashes), np.int64)
        self.below[self.at] = seen
        self.context, self.occurs = np.roll(mix(self.context, self.hashes), 1), np.roll(self.below, 1)
        self.occurs[self.first] = 0


def answer_words(blobs: list[bytes], sizes: list[int]) -> tuple[list[bytes], int, int]:
    """Each question's counts over all training texts, their sum and how many words they are of."""
    blobs = [unzipped(b) for b in blobs]
    keys = np.concatenate([unpack_keys(b, m, 5, 0, True) for b, m in zip(blobs, sizes)])
    n = np.concatenate([unpack_counts(b, m, 5 * m)[0] for b, m in zip(blobs, sizes)])
    _, where = np.unique(keys, return_inverse=True)
    counts = np.bincount(where, n).astype(np.int64)
    cuts = np.cumsum([0, *sizes])
    return [zipped(pack_counts(counts[where[a:b]])) for a, b in zip(cuts, cuts[1:])], int(counts.sum()), int((counts > 0).sum())


def verdict(counts: np.ndarray, below: np.ndarray, owner: np.ndarray, total: np.ndarray, times: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each context, from its kept symbols' counts and suffix probabilities: how many it keeps and one (0: not retained), and how often others follow."""
    kinds = np.bincount(owner, times * (counts > 0), len(total)).astype(np.int64)
    rest = total - np.bincount(owner, times * counts, len(total)).astype(np.int64)
    # The training texts' log-likelihood under the smoothed state, less that under its suffix.
    back = np.maximum(rest + DISCOUNT * kinds, 1e-9) / np.maximum(total, 1)
    own = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[owner] + back[owner] * below
    gain = np.bincount(owner, times * counts * np.log(own / below), len(total)) + rest * np.log(back)
    return np.where((gain > GAIN * kinds) & (kinds > 0), kinds + 1, 0), np.maximum(rest, 0)


def judge(parts: list[bytes]) -> np.ndarray:
    """The verdict on a context that is dealt, from what `answer` sums up of its parts: (context, told, rest)."""
    each = [np.frombuffer(unzipped(x), "<u8") for x in sorted(parts)]
    keys, place = np.unique(np.concatenate([x[2:].reshape(2, -1)[0] for x in each]), return_inverse=True)
    times = np.bincount(place, np.concatenate([x[2:].reshape(2, -1)[1] for x in each])).astype(np.int64)
    counts, below = (keys >> np.uint64(8)).astype(np.int64), np.exp((keys & np.uint64(255)).astype(np.float64) / -8)
    told, rest = verdict(counts, below, np.zeros(len(keys), np.int64), each[0][1:2].astype(np.int64), times)
    return np.array([each[0][0], told[0], rest[0]], "<u8")


def answer(blobs: list[bytes], hot: int, fixed: bool) -> tuple[list[bytes], dict[int, tuple[bytes, list[int]]]]:
    """For each question's contexts how many symbols they keep and one (0: not retained) and how often others follow; then its pairs' counts.

    Of contexts that are dealt, a part is here: by context, what it counts for `judge`, and the places of the questions that have it.
    """
    routes, totals, succ, words, low, n, shape, dealt = [], [], [], [], [], [], [], []
    for blob in map(unzipped, blobs):
        c, p = np.frombuffer(blob, "<i8", 2).tolist()
        routes.append(unpack_keys(blob, c, 4, 16, True))
        got, at = unpack_counts(blob, c, 16 + 4 * c)
        totals.append(got)
        got, at = unpack_counts(blob, c, at)
        succ.append(got)
        words.append(unpack_keys(blob, p, 4, at, True))
        low.append(np.frombuffer(blob, np.uint8, p, at + 4 * p))
        got, at = unpack_counts(blob, p, at + 5 * p)
        n.append(got)
        shape.append((c, p))
        dealt.append(np.frombuffer(blob, "<u8", (len(blob) - at) // 8, at).reshape(2, -1))
    _, first, context = np.unique(np.concatenate(routes), return_index=True, return_inverse=True)
    total = np.concatenate(totals)[first]
    pairs, first, pair = np.unique((np.repeat(context, np.concatenate(succ)).astype(np.uint64) << np.uint64(32)) | np.concatenate(words), return_index=True, return_inverse=True)
    counts = np.bincount(pair, np.concatenate(n), len(pairs)).astype(np.int64)
    owner, below = (pairs >> np.uint64(32)).astype(np.int64), np.exp(np.concatenate(low)[first] / -8)
    told, rest = verdict(counts, below, owner, total)
    told = np.where(total > hot, int(fixed), told)
    out, c0, p0 = [], 0, 0
    for c, p in shape:
        here = context[c0 : c0 + c]
        out.append(zipped(pack_counts(told[here]) + pack_counts(rest[here]) + pack_counts(counts[pair[p0 : p0 + p]])))
        c0, p0 = c0 + c, p0 + p
    return out, _parts(dealt, totals, context, hot, owner, counts, np.concatenate(low)[first].astype(np.uint64))


def _parts(dealt: list[np.ndarray], totals: list[np.ndarray], context: np.ndarray, hot: int, owner: np.ndarray, counts: np.ndarray, low: np.ndarray) -> dict[int, tuple[bytes, list[int]]]:
    """(context, its occurrences, each count with its suffix probability, how many symbols have both) and who asked, of each context that is dealt."""
    asked: dict[int, list[int]] = {}
    size, here = {}, {}
    ends = np.cumsum([0, *map(len, totals)])
    for k, whole in enumerate(dealt):
        if whole.size:
            mine = context[ends[k] : ends[k + 1]][totals[k] > hot]
            for c, n, part in zip(*whole.tolist(), mine.tolist()):
                who = asked.setdefault(c, [])
                if not who or who[-1] != k:
                    who.append(k)
                size[c] = n
                here.setdefault(c, set()).add(part)
    out = {}
    for c, who in asked.items():
        mine = np.isin(owner, list(here[c]))
        keys, times = np.unique(counts[mine].astype(np.uint64) << np.uint64(8) | low[mine], return_counts=True)
        out[c] = zipped(np.concatenate([np.array([c, size[c]], np.uint64), keys, times.astype(np.uint64)]).astype("<u8").tobytes()), who
    return out


def _tokenised(docs: DataFrame, id_col: str, text_col: str, folds: int, batch_bytes: int) -> DataFrame:
    """One row a batch of texts: ids and folds, tokens as places in the batch's words, most frequent first, and the words' hashes."""
    kind = dict(docs.dtypes)[id_col]
    out_of = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds == 0
    texts = docs.select(F.col(id_col).alias("id"), out_of.alias("held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        part, made = TaskContext.get().partitionId(), 0
        ids, held, split, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            made += 1
            found = list(set().union(*split))
            place = {w: i for i, w in enumerate(found)}
            n = np.array([len(s) for s in split])
            tokens = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
            often = np.bincount(tokens, minlength=len(found))
            by = np.argsort(-often, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))[by]
            whole = pa.concat_arrays(ids)
            row = [pa.array([(part << 32) + made], pa.int64()), pa.ListArray.from_arrays([0, len(whole)], whole), *(pa.array([x.tobytes()], pa.binary()) for x in (pa.concat_arrays(held).to_numpy(zero_copy_only=False), n.astype("<i4"))), pa.array([planes(rank[tokens])], pa.binary()), pa.array([hashes.tobytes()], pa.binary())]
            ids.clear(), held.clear(), split.clear()
            return pa.RecordBatch.from_arrays(row, ["batch", "ids", "held", "sizes", "tokens", "words"])

        for batch in batches:
            lo = 0
            for i, body in enumerate(batch.column(2)):
                raw = body.as_py()
                split.append([*words_of(raw), END])
                size += len(raw)
                if size >= batch_bytes or i + 1 == batch.num_rows:
                    ids.append(batch.column(0).slice(lo, i + 1 - lo))
                    held.append(batch.column(1).slice(lo, i + 1 - lo))
                    lo = i + 1
                    if size >= batch_bytes:
                        yield packed()
                        size = 0
        if split:
            yield packed()

    return texts.mapInArrow(run, f"batch long, ids array<{kind}>, held binary, sizes binary, tokens binary, words binary")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, depth: int = DEPTH, hot: int | None = None, batch_bytes: int = BATCH_BYTES, deal: int = HOT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Contexts with more than `deal` occurrences are dealt to buckets by next words, which changes no score. Only if a caller passes `hot`, those with
    more than `hot` occurrences are another model: retained without the test and smoothed by HOT_WEIGHT.
    A null or empty text is the end token alone. A null id is held out. Repeated rows count as often as they come, and score alike. A
    very long text is a batch of its own. With no training text the model is uniform. An empty table gives an empty table; other columns are not read.
    """
    kind, n = dict(docs.dtypes)[id_col], partitions(docs.sparkSession)
    fixed, most = hot is not None, deal if hot is None else hot
    rows = _tokenised(docs, id_col, text_col, folds, batch_bytes)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    labels = B.even_labels(n, max(2, round(int(size) / BUCKET_BYTES / n)))
    place = {x: i for i, x in enumerate(labels)}
    told, question = "batch long, bucket int, level int, blob binary", "bucket int, batch long, size int, blob binary"

    def loaded(table: pa.Table) -> Batch:
        get = lambda c, t: np.frombuffer(table[c][0].as_py(), t)
        tokens = np.frombuffer(unzipped(table["tokens"][0].as_py()), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
        return Batch(get("words", np.uint64), tokens, get("sizes", "<i4").astype(np.int64), get("held", bool), len(labels))

    def questions(batch: int, asked: dict[int, bytes], sizes: list[int] | None = None) -> pa.Table:
        return pa.table({"bucket": pa.array([labels[b] for b in asked], pa.int32()), "batch": pa.array([batch] * len(asked), pa.int64()), "size": pa.array(sizes or [0] * len(asked), pa.int32()), "blob": pa.array(list(asked.values()), pa.binary())})

    def ask_words(key: tuple, mine: pa.Table) -> pa.Table:
        it = loaded(mine)
        return questions(key[0].as_py(), it.word_question(), [hi - lo for _, lo, hi in it._cut(it.words[it.order])])

    def tell_words(key: tuple, asked: pa.Table) -> pa.Table:
        blobs, total, kinds = answer_words(asked["blob"].to_pylist(), asked["size"].to_pylist())
        first = [1] + [0] * (len(blobs) - 1)
        return pa.table({"batch": asked["batch"], "bucket": asked["bucket"], "level": pa.array([0] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary()), "n": pa.array([total * f for f in first], pa.int64()), "v": pa.array([kinds * f for f in first], pa.int64())})

    grouped = rows.groupBy("batch")
    counted = grouped.applyInArrow(ask_words, question).groupBy("bucket").applyInArrow(tell_words, f"{told}, n long, v long")
    # How many tokens the training texts have, and of how many kinds: one row, asked for inside the plan.
    sums = counted.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).alias("sums")).scalar()

    def replayed(mine: pa.Table, answers: pa.Table, levels: int) -> tuple[Batch, int]:
        """The batch after so many rounds, and the number of training tokens."""
        by_level: list[dict[int, bytes]] = [{} for _ in range(levels)]
        verdicts: list[list[bytes]] = [[] for _ in range(levels)]
        for level, bucket, blob in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "blob"))):
            if bucket < 0:
                verdicts[level].append(blob)
            else:
                by_level[level][place[bucket]] = blob
        total = answers["sums"][0].as_py()
        it = loaded(mine)
        it.take_words(by_level[0], total["n"], total["v"])
        for got, of_dealt in zip(by_level[1:], verdicts[1:]):
            it.ask(most, fixed)
            it.take(got, np.frombuffer(b"".join(of_dealt), "<u8").reshape(-1, 3) if of_dealt else np.zeros((0, 3), np.uint64))
        return it, total["n"]

    def round_of(level: int):  # noqa: ANN202
        def rows_of(batches: list[int], buckets: list[int], blobs: list[bytes]) -> pa.Table:
            return pa.table({"batch": pa.array(batches, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "level": pa.array([level] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

        def ask(key: tuple, mine: pa.Table, got: pa.Table) -> pa.Table:
            if not mine.num_rows:  # parts of a context, not answers
                return questions(0, {})
            it, _ = replayed(mine, got, level)
            it.ask(most, fixed)
            return questions(key[0].as_py(), it.question())

        def tell(key: tuple, asked: pa.Table) -> pa.Table:
            asked = asked.sort_by("batch")  # sums don't depend on the order of arrival
            out, parts = answer(asked["blob"].to_pylist(), most, fixed)
            batches = asked["batch"].to_pylist()
            # Parts go to their context, which stands as a negative batch, with the batches that ask about it.
            own = [np.array([len(who), *(batches[k] for k in who)], "<i8").tobytes() + part for part, who in parts.values()]
            return rows_of([*batches, *(-1 - (c >> 2) for c in parts)], [key[0].as_py()] * (len(out) + len(own)), out + own)

        def decide(key: tuple, parts: pa.Table) -> pa.Table:
            if key[0].as_py() >= 0:
                return rows_of([], [], [])
            by_context: dict[int, tuple[list[bytes], set[int]]] = {}
            for blob in parts["blob"].to_pylist():
                k = int.from_bytes(blob[:8], "little")
                part = blob[8 + 8 * k :]
                mine, who = by_context.setdefault(int.from_bytes(unzipped(part)[:8], "little"), ([], set()))
                mine.append(part)
                who.update(np.frombuffer(blob, "<i8", k, 8).tolist())
            rows = [(b, judge(mine).tobytes()) for mine, who in by_context.values() for b in sorted(who)]
            return rows_of([b for b, _ in rows], [-1] * len(rows), [x for _, x in rows])

        return ask, tell, decide

    # Dealt by batch once, then read by every later round.
    by_batch = lambda df: df.repartition(n, "batch")
    answers = by_batch(counted.select("batch", "bucket", "level", "blob"))
    with_sums = lambda df: df.withColumn("sums", sums).groupBy("batch")
    for ask, tell, decide in map(round_of, range(1, depth + 1)):
        asked = grouped.cogroup(with_sums(answers)).applyInArrow(ask, question)
        new = by_batch(asked.groupBy("bucket").applyInArrow(tell, told))
        answers = answers.unionByName(new).unionByName(by_batch(new.groupBy("batch").applyInArrow(decide, told)))

    def finish(key: tuple, mine: pa.Table, got: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"id": mine["ids"].combine_chunks().flatten(), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        it, tokens = replayed(mine, got, depth + 1)
        by_text = lambda x: np.add.reduceat(x, it.first)
        return pa.table({
            "id": mine["ids"].combine_chunks().flatten(), "held_out": pa.array(np.frombuffer(mine["held"][0].as_py(), bool)), "n_tokens": pa.array(it.sizes),
            "n_known": pa.array(by_text((it.count > 0)[it.tokens].astype(np.int64))), "train_tokens": pa.array([tokens] * len(it.sizes), pa.int64()),
            "base_score": pa.array(by_text(it.base[it.tokens]) / math.log(10)), "score": pa.array(by_text(it.log_p) / math.log(10)),
        })

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return grouped.cogroup(with_sums(answers)).applyInArrow(finish, schema).withColumnRenamed("id", id_col)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
