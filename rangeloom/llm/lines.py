"""Line dedup with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed; a hash found in enough distinct documents loses all
its lines but those of the largest doc_id that holds it; documents are put together again by position.

Plan: one narrow shuffle of (hash, document) that is combined before it is sent (a line in a third of all documents
arrives as counts), one of the long lines' hashes to meet the few dropped hashes, and one of the texts by document.
A hash is two independent 64-bit values, so that a chance agreement is out of reach at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import WHITE_SPACE, Shelf, free_names, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased, other letters as they are.

    The UTF-8 bytes are read as Latin-1 and lower-cased: A-Z become a-z, and of the other bytes only lead bytes of
    two-byte characters move, to values that no two-byte character starts with; so keys are equal exactly if the
    ASCII-lower-cased lines are. (`translate` says the same at many times the cost.)
    """
    return F.lower(F.decode(F.encode(F.btrim(line, F.lit(WHITE_SPACE)), "UTF-8"), "ISO-8859-1"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, shelf: Shelf | None = None) -> DataFrame:
    """All columns of docs, with the text's repeated lines dropped, and `line_counts` (n_lines, n_dropped; with underscores after its name where docs has such a column).

    A null or empty text is one empty line. Rows with the same id are one document; a null id counts as a document
    of its own that is smaller than any other. Repeated rows stay repeated; a key that only one document holds, however often, is
    none of many documents. A very long text is one row of lines. An empty table gives an empty table; other columns pass through
    whatever their names.
    """
    (counts,) = free_names(docs, "line_counts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
    split = base.select("id", "th", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).select("id", "th", "pos", F.btrim("line", F.lit(WHITE_SPACE)).alias("line"))
    long = split.where(F.char_length("line") >= min_chars).select("id", "th", "pos", line_key(F.col("line")).alias("key")).select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    repeated = long.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    # Written, so that both sides of the join come from shuffles of their own and a hot line's share can be split.
    repeated = (shelf or Shelf(docs.sparkSession)).keep(repeated)
    lost = long.join(repeated.select("h1", "h2", "keeper"), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id", "th").agg(F.collect_set("pos").alias("lost"))
    met = base.alias("b").join(lost.alias("l"), F.col("b.id").eqNullSafe(F.col("l.id")) & (F.col("b.th") == F.col("l.th")), "left").select("row", F.split("body", "\n", -1).alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    kept = F.when(F.size("lost") == 0, F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost"), lambda i: F.get("lines", i)), "\n")
    )
    out = met.select("row", kept.alias("kept"), F.struct(F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped")).alias(counts))
    own = [F.col("kept").alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*own, counts)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same rows for DuckDB: keys by regular expression, everything else by windows over unnested lines.
OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, r.k IS NOT NULL AND l.doc_id <> r.keeper AS lost
  FROM keyed l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
