"""Toxicity scores from a counterfactual-regularised classifier.

A logistic regression over words and word beginnings is fitted to labelled texts. Where a labelled text names a group, the
name is swapped for each of the others, and the squared difference of the two scores is a penalty of the loss: the
fit can't lean on who is named, so neutral mentions of a group stay neutral.

The fit sees at most TRAIN_ROWS labelled rows, the first by a hash of their id; the bound is the driver's memory. Features are counted
by class in Spark, and only those that the fit uses, a few thousand, come to the driver, a row's at a time as packed numbers. Scoring
is one Arrow map over all texts with the weights that the fit kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import Shelf, table, text_or_empty

TRAIN_ROWS = 12_000
LEVELS = (1, 2, 3, 5)
#: Names of groups, by kind: a swap stays inside its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("femmes", "hommes", "musulman", "juif", "noir", "blanc"),
    ("frauen", "männer", "muslime", "juden", "schwarze", "weiße"),
    ("mujeres", "hombres", "musulmanes", "judíos", "negros", "blancos"),
)
SWAPS = {w: tuple(x for x in kind if x != w) for kind in IDENTITIES for w in kind}
_EDGES = re.compile(r"^\W+|\W+$")


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a bare word and of its beginnings of four to seven letters."""
    parts = [word + "$", *(word[:k] for k in range(4, 8) if len(word) >= k)]
    return tuple({zlib.crc32(p.encode()) for p in parts})


def bare_words(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        bare = _EDGES.sub("", word)
        if bare:
            out[bare] += n
    return out


class Features:
    """Texts as sets of (feature, how often at least); with `known`, only of those features."""

    def __init__(self, known: set[int] | None = None, most: int = 300_000):
        self.known, self.most = known, most
        self.of_word: dict[str, tuple[int, ...]] = {}

    def of(self, words: Counter) -> list[int]:
        count: dict[int, int] = {}
        for word, n in words.items():
            got = self.of_word.get(word)
            if got is None:
                got = word_features(word)
                if self.known is not None:
                    got = tuple(f for f in got if f in self.known)
                if len(self.of_word) > self.most:
                    self.of_word.clear()
                self.of_word[word] = got
            for f in got:
                count[f] = count.get(f, 0) + n
        return [f * 8 + k for f, n in count.items() for k, level in enumerate(LEVELS) if n >= level]


def swapped(words: Counter) -> list[Counter]:
    """The text's words with each named group swapped for each other of its kind."""
    out = []
    for word in sorted(w for w in words if w in SWAPS):
        for other in SWAPS[word]:
            new = words.copy()
            new[other] += new.pop(word)
            out.append(new)
    return out


def uses(in_pos, in_all, pos, neg, log=np.log, sqrt=np.sqrt, least=np.minimum, size=np.abs):  # noqa: ANN001, ANN201
    """Whether a feature is fitted: met in four rows or more, and not about as often in either class. For arrays or columns."""
    odds = size(log((in_pos + 0.5) / (pos + 1)) - log((in_all - in_pos + 0.5) / (neg + 1)))
    return (in_all >= 4) & (odds * sqrt(least(in_pos + 0.5, in_all)) > 2.5) & (odds > 0.7)


def fit(rows: list[tuple[np.ndarray, int, list[np.ndarray]]], penalty: float = 5.0, ridge: float = 0.3, rounds: int = 150) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias, from (features, label, features of each counterfactual) rows."""
    labels = np.array([r[1] for r in rows], float)
    pos, neg = labels.sum(), len(labels) - labels.sum()
    sizes = np.array([len(r[0]) for r in rows], np.int64)
    names, column = np.unique(np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)]), return_inverse=True)
    in_pos, in_all = np.bincount(column, np.repeat(labels, sizes), len(names)), np.bincount(column, minlength=len(names))
    names = names[uses(in_pos, in_all, pos, neg)] if len(names) else names
    return fit_used(names, [(r[0], r[1], [(np.setdiff1d(r[0], c), np.setdiff1d(c, r[0])) for c in r[2]]) for r in rows], penalty, ridge, rounds)


def fit_used(names: np.ndarray, rows: list[tuple[np.ndarray, int, list[tuple[np.ndarray, np.ndarray]]]], penalty: float = 5.0, ridge: float = 0.3, rounds: int = 150) -> tuple[dict[int, float], float]:
    """Weights of the features `names` (sorted) and the bias, from (features, label, features lost and won by each counterfactual) rows.

    Full-batch Adam on the mean loss plus `penalty` times the mean squared logit difference to the counterfactuals. One
    class only, or no row: no weights, and the bias of the smoothed share.
    """
    labels = np.array([r[1] for r in rows], float)
    pos, neg = labels.sum(), len(labels) - labels.sum()
    bias = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg or not len(names):
        return {}, bias

    def places(features: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, features), len(names) - 1)
        return at[names[at] == features]

    own = [places(r[0]) for r in rows]
    row, column = np.repeat(np.arange(len(rows)), [len(x) for x in own]), np.concatenate(own)
    # Differences between a text and each of its counterfactuals, as signed sparse rows.
    parts = [(sign, places(f)) for r in rows for lost, won in r[2] for sign, f in ((1.0, lost), (-1.0, won))]
    n_diff = len(parts) // 2
    sizes = [len(f) for _, f in parts]
    d_row, d_val = np.repeat(np.arange(len(parts)) // 2, sizes), np.repeat([sign for sign, _ in parts], sizes)
    d_col = np.concatenate([np.zeros(0, np.int64), *(f for _, f in parts)])
    w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    w[-1] = bias
    n = len(rows)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column], n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(column, error[row], len(names)), error.sum()) / n
        g[:-1] += ridge * w[:-1] / n
        if len(d_row):
            d = np.bincount(d_row, d_val * w[d_col], n_diff)
            g[:-1] += 2 * penalty * np.bincount(d_col, d_val * d[d_row], len(names)) / n_diff
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return {f: float(x) for f, x in zip(names.tolist(), w[:-1])}, float(w[-1])


def _held_out(ident: object, folds: int) -> bool:
    return zlib.crc32(b"" if ident is None else str(ident).encode()) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, rows: int = TRAIN_ROWS, penalty: float = 5.0, shelf: Shelf | None = None) -> tuple[dict[int, float], float]:
    """The classifier from labelled texts outside the held-out fold; at most `rows` of them, the first by their id's hash.

    Null labels and ids are left out; of repeated labels the larger counts, of repeated ids the least text. No labels: no weights.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold != 0)).groupBy(id_col).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    labelled = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                own, lost, won = [], [], []
                for text in part.column(0):
                    words = bare_words(text.as_py())
                    mine, others = set(features.of(words)), [set(features.of(x)) for x in swapped(words)]
                    own.append(sorted(mine))
                    lost.append([sorted(mine - x) for x in others])
                    won.append([sorted(x - mine) for x in others])
                lists = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([int(y > 0) for y in part.column(1).to_pylist()], pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(lost, lists), pa.array(won, lists)], ["y", "x", "lost", "won"])

    made = shelf.keep(labelled.select("text", "label").mapInArrow(run, "y int, x array<long>, lost array<array<long>>, won array<array<long>>"))
    size = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    pos, neg = int(size[1]), int(size[0]) - int(size[1])
    counted = made.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.sum("y").alias("in_pos"), F.count(F.lit(1)).alias("in_all"))
    used = counted.where(uses(F.col("in_pos"), F.col("in_all"), pos, neg, F.log, F.sqrt, F.least, F.abs))
    names = np.sort(used.select("f").toArrow()["f"].to_numpy())  # each in four rows at least, so bounded by the rows
    known = docs.sparkSession.sparkContext.broadcast(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(features: list[int]) -> list[int]:
            x = np.array(features, np.int64)
            return x[np.isin(x, known.value)].tolist()

        for batch in batches:
            cols = [batch.column(0), pa.array([of(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))]
            cols += [pa.array([[of(x) for x in xs] for xs in batch.column(k).to_pylist()], pa.list_(pa.list_(pa.int64()))) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays(cols, ["y", "x", "lost", "won"])

    got = made.mapInArrow(pack, made.schema).toArrow()
    shelf.drop(made)
    array = lambda x: np.array(x, np.int64)
    return fit_used(names, [(array(x), y, [(array(a), array(b)) for a, b in zip(lost, won)]) for y, x, lost, won in zip(*(got[c].to_pylist() for c in ("y", "x", "lost", "won")))], penalty)


def score_texts(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) for each row.

    A null or empty text has the score of the bias; a very long one is scored whole. Repeated rows score alike, a score of exactly a
    half is predicted toxic; a null id is carried and held out; an empty table gives an empty table; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        features = Features({f >> 3 for f in weights})
        for batch in batches:
            z = np.array([bias + sum(weights.get(f, 0.0) for f in features.of(bare_words(x.as_py()))) for x in batch.column(1)])
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            out = [_held_out(x, folds) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
