"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Strict rules look for one kind of junk each and are seldom wrong; loose ones look for a little of it, vote good where there is none, and
are outvoted by the others where they are alone.

One Arrow map over the scan measures each text and lets the rules vote. The distinct vote patterns, at most 3**rules of
them whatever the corpus, are counted over all documents; expectation-maximisation runs on those counts on the driver, and
each pattern's posterior goes back as a literal map of the same bound. Documents are never collected, and a second
look at them is a map lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import WHITE_SPACE, Shelf, table, text_or_empty

SYMBOLS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Between which shares of the good texts that a rule votes on it may vote bad, for strict and loose rules. Beliefs about rules, not fitted to labels.
WRONG_STRICT, WRONG_LOOSE = (0.0005, 0.005), (0.05, 0.2)
STRICT = ("symbols", "capitals", "repeats", "lines", "marks", "letters", "doubled")
LOOSE = ("some symbols", "some capitals", "some repeats", "some doubled", "length", "word length")
RULES = STRICT + LOOSE


def measure(text: str) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and how many capitals, exclamation marks and words equal to the one before."""
    data = text.encode()
    words = data.split()
    n = len(words)
    white = sum(map(text.count, WHITE_SPACE))
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            twice = np.zeros(len(windows), bool)
            for i, w in enumerate(windows):
                j = seen.setdefault(w, i)
                if j != i:
                    twice[i] = twice[j] = True
            edges = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + 5, -1)
            repeated = int((np.cumsum(edges)[:n] > 0).sum())
    lines = [x for x in text.split("\n") if x.strip(WHITE_SPACE)]
    raw = np.frombuffer(data, np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    return n, len(text) - white, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, capitals, text.count("!"), sum(map(eq, words, words[1:]))


def votes(n: int, chars: int, symbols: int, dup_lines: int, repeats: int, capitals: int, marks: int, doubled: int) -> tuple[int, ...]:
    """One vote a rule, in the order of RULES: 1 good, 0 bad, 2 abstains.

    A strict rule abstains where it finds no junk: its silence is no praise of the text. A text without words is voted bad by its length alone.
    """
    if n == 0:
        return (2,) * 11 + (0, 2)
    bad_if = lambda x: 0 if x else 2
    graded = lambda bad, good: 0 if bad else 1 if good else 2
    return (
        bad_if(symbols >= 0.3 * n), bad_if(capitals >= 0.4 * chars), bad_if(repeats >= 0.2 * n), bad_if(dup_lines >= 0.3 * n), bad_if(marks >= 0.3 * n), bad_if(chars > 30 * n), bad_if(doubled >= 0.3 * n),
        graded(symbols >= 0.03 * n, symbols == 0), graded(capitals >= 0.15 * chars, capitals <= 0.1 * chars), graded(repeats >= 0.05 * n, repeats == 0 and n >= 50),
        graded(doubled >= 0.1 * n, doubled <= 0.02 * n and n >= 50), graded(n < 10, n >= 30), graded(not 3 * n <= chars <= 12 * n, 4 * n <= chars <= 8 * n),
    )


def fit_accuracies(patterns: dict[str, int], rounds: int = 100, prior: float = 0.85) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by EM over their counts.

    A rule has, for good and for bad texts each, the rate at which it votes bad when it votes; an abstention is no evidence.
    The share of good texts (prior) is given: estimated too, the fit drifts to a single class, as each strict rule knows one kind
    of junk only. On good texts the rates stay inside WRONG_STRICT and WRONG_LOOSE, so one strict vote decides and a loose one can be
    outvoted; no rule is read backwards. Pseudo-counts keep the rates inside (0, 1), so that a corpus of one pattern is well
    defined. Patterns with equal votes have equal posteriors; no documents give an empty map.
    """
    if not patterns:
        return {}
    v = np.array([[int(c) for c in p] for p in patterns])
    count = np.array(list(patterns.values()), float)
    bad, voted = (v == 0).astype(float), (v != 2).astype(float)
    lo, hi = (np.array([WRONG_STRICT[k]] * len(STRICT) + [WRONG_LOOSE[k]] * len(LOOSE)) for k in (0, 1))
    start = {"good": hi / 2, "bad": np.full(len(RULES), 0.5)}
    rate = dict(start)
    for _ in range(rounds):
        odds = {k: bad @ np.log(r) + (voted - bad) @ np.log1p(-r) for k, r in rate.items()}
        post = 1 / (1 + np.exp(np.clip(np.log1p(-prior) - np.log(prior) + odds["bad"] - odds["good"], -500, 500)))
        share = {"good": count * post, "bad": count * (1 - post)}
        rate = {k: (x @ bad + 10 * start[k]) / (x @ voted + 10) for k, x in share.items()}
        rate["good"] = np.clip(rate["good"], lo, hi)
        rate["bad"] = np.maximum(rate["bad"], rate["good"])
    return dict(zip(patterns, (round(float(x), 12) for x in post)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, shelf: Shelf | None = None) -> DataFrame:
    """(id, the features, base_failed, quality, kept) for each row.

    A null or empty text has no words and fails the base rules; a very long one is measured whole. Repeated rows are judged alike, a
    null id is carried; an empty table gives an empty table. Other columns are not read. A posterior of exactly `least` is kept.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column(1)]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            votes_of = pa.array(["".join(map(str, votes(*r))) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, votes_of], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"])

    seen = shelf.keep(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, {FEATURES}, votes string"))
    patterns = {r[0]: r[1] for r in seen.groupBy("votes").count().orderBy("votes").collect()}
    posterior = fit_accuracies(patterns)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if posterior:
        table_of = F.create_map(*[F.lit(x) for kv in posterior.items() for x in kv])
        quality = table_of[F.col("votes")]
    else:
        quality = F.lit(None).cast("double")
    return seen.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= least)).alias("kept")
    )


def keep_rows(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, each by its own text, whatever its id; all columns stay.

    The texts are measured twice, once to count vote patterns and once to decide, so no row needs a key and none is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, votes(*measure(x.as_py())))) for x in batch.column(0)], pa.string())], ["votes"])

    patterns = {r[0]: r[1] for r in docs.select(text_or_empty(text_col)).mapInArrow(count, "votes string").groupBy("votes").count().orderBy("votes").collect()}
    posterior, at = fit_accuracies(patterns), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py() or "") for x in batch.column(at)]
            yield batch.filter(pa.array([r[0] >= 10 and 100 * r[4] <= 20 * r[0] and posterior["".join(map(str, votes(*r)))] >= least for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
