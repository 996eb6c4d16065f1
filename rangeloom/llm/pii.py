"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are what fixed forms find: e-mail and IP addresses, card numbers, phone numbers, and long hexadecimal runs as seeds of secrets. The
words around a seed make several patterns of its kind: one, two or three words on the left, one or two on the right, one on
both sides; each holds a letter. Patterns are also met by other identifier-like strings of any form. Patterns and strings are a graph
that is scored in rounds until nothing new is known: a pattern is worth the share of its distinct strings that are known to be of its kind
(strings of no known kind weigh half), less where they are few; a string is worth the joint confidence of the best pattern on each side of it. Strings over the
threshold become known, raise other patterns, and are spans wherever a trusted pattern meets them. A seed of a secret is itself a span
only there.

Every stage works on matches, which are few: texts are split once a kind and leave as (piece length, match) rows, positions
are running sums over a document's matches, and the texts themselves are never shuffled. Matches of a document are the largest group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import Shelf, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns: they match the same strings without going back over long runs. A start inside a
#: run can only match where its beginning does; \G lets a run begin right after the match before. Card and phone already
#: ask for their numbers of digits: their matches are whole runs, so a run of other length is no match either way.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])",
}
#: A text that holds none of these has no match; digits in such a row are asked for by the cheap search first.
NEEDS = {"email": ("@",), "ip": (".",), "phone": ("+",), "spelled": ("(at)", "[at]", "{at}")}
#: What else may be an identifier: a run with digits in it, or an address whose sign is spelled out.
OTHER = r"(?<![0-9A-Za-z@._()+/-])[A-Za-z(+._@/-]*+[0-9][0-9A-Za-z@._()+/-]*+"
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]++)++"
SECRET = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,128}$"
LEAST_DIGITS = 4
LEAST_SUPPORT = 4
LEAST_SHARE = 0.6
TRUST = 0.65
#: Characters of context on each side; a word that reaches over the edge counts by the part inside.
CONTEXT = 120


def _matches(texts: DataFrame, kind: str, form: str) -> DataFrame:
    """(id, th, kind, start, end, found, left, right) of each match: code points, end exclusive, and the words on each side, back to the match before."""
    has = reduce(or_, [F.col("body").contains(x) for x in NEEDS[kind]]) if kind in NEEDS else F.col("body").rlike("[0-9]")
    split = texts.where(has).select(
        "id", "th", F.split("body", form, -1).alias("pieces"), F.regexp_extract_all("body", F.lit(form), 0).alias("found")
    ).where(F.size("found") > 0)
    cut = F.transform(
        F.col("found"),
        lambda x, i: F.struct(
            i.alias("i"), F.char_length(F.get("pieces", i)).alias("gap"), x.alias("found"), F.right(F.get("pieces", i), F.lit(CONTEXT)).alias("before"), F.left(F.get("pieces", i + 1), F.lit(CONTEXT)).alias("after")
        ),
    )
    rows = split.select("id", "th", F.explode(cut).alias("m")).select("id", "th", "m.*").distinct()
    until = Window.partitionBy("id", "th").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.char_length("found")).over(until)
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "[0-9]", "0")), r"\s+"), lambda w: w != "")
    return rows.withColumn("end", end).select("id", "th", F.lit(kind).alias("kind"), (F.col("end") - F.char_length("found")).alias("start"), "end", "found", words("before").alias("left"), words("after").alias("right"))


def _luhn(digits: Column) -> Column:
    """Whether the digits' checksum holds: from the right, every second digit doubled, less nine if over nine."""
    at = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(at, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(texts: DataFrame) -> DataFrame:
    """The base matches of (id, th, body) rows that pass the checks of their kind."""
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    checks = {"email": F.lit(True), "ip": F.col("found").rlike(rf"^{part}(?:\.{part}){{3}}$"), "card": _luhn(F.regexp_replace("found", "[^0-9]", "")), "phone": F.lit(True)}
    out = None
    for kind in KINDS:
        one = _matches(texts, kind, FORMS[kind]).where(checks[kind])
        out = one if out is None else out.unionByName(one)
    return out


def _patterns(matches: DataFrame) -> DataFrame:
    """The matches, one row for each of their patterns: its side and hash."""
    said = lambda words, n, of: F.when(F.size(words) >= n, F.concat_ws(" ", F.lit(f"{of}{n}"), F.slice(words, -n, n) if of == "l" else F.slice(words, 1, n)))
    left, right = F.col("left"), F.col("right")
    both = F.when((F.size(left) >= 1) & (F.size(right) >= 1), F.concat_ws(" ", F.lit("b"), F.slice(left, -1, 1), F.slice(right, 1, 1)))
    texts = [("l", said(left, 1, "l")), ("l", said(left, 2, "l")), ("l", said(left, 3, "l")), ("r", said(right, 1, "r")), ("r", said(right, 2, "r")), ("b", both)]
    each = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), text.alias("text")) for side, text in texts]))
    named = matches.withColumn("p", each).where(F.col("p.text").rlike(r"^\S+ .*\p{L}"))
    return named.select("id", "th", "start", "end", "kind", F.lower("found").alias("string"), F.col("p.side").alias("side"), F.xxhash64("p.text").alias("pattern"))


def _bootstrap(seeds: DataFrame, others: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, th, kind, start, end) of the strings in others that trusted patterns name; a seed in others has a kind, the rest none."""
    met = shelf.keep(_patterns(others))
    edges = shelf.keep(_patterns(seeds).select("pattern", "side", "string").unionByName(met.select("pattern", "side", "string")).distinct())
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SUPPORT)
    may = shelf.keep(edges.join(size, "pattern"))
    known = shelf.keep(seeds.select("kind", F.lower("found").alias("string")).unionByName(others.where("kind is not null").select("kind", F.lower("found").alias("string"))).distinct())
    n_known = known.count()
    while True:
        of_kind = may.join(known, "string").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("k"))
        told = may.join(known.select("string").distinct(), "string").groupBy("pattern").agg(((F.count(F.lit(1)) + F.first("n")) / 2).alias("weight"))
        share = of_kind.where(F.col("k") >= LEAST_SUPPORT).join(told, "pattern").withColumn("share", F.col("k") / F.col("weight")).where(F.col("share") >= LEAST_SHARE)
        trusted = shelf.keep(share.select("pattern", "kind", (F.col("share") * (1 - 1 / (1 + F.log2("k")))).alias("worth")))
        best = may.join(trusted, "pattern").groupBy("kind", "string", "side").agg(F.max("worth").alias("worth"))
        found = best.groupBy("kind", "string").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("worth"), F.lit(1e-9)))))).alias("score")).where(F.col("score") >= TRUST)
        new = shelf.keep(known.unionByName(found.select("kind", "string")).distinct())
        n_new = new.count()
        if n_new == n_known:
            return met.drop("kind").join(trusted.select("pattern", "kind"), "pattern").join(known, ["kind", "string"]).select("id", "th", "kind", "start", "end").distinct()
        known, n_known = new, n_new


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shelf: Shelf | None = None) -> DataFrame:
    """(id, base, added, spans) for each row: arrays of (start, kind_at, kind, end), in this order of place and kind.

    A null or empty text has no spans; a very long one is searched whole. Repeated rows have the same spans and count once as
    evidence, which goes by distinct strings; rows with one id and different texts are told apart by their texts. A null id is carried;
    an empty table gives an empty table; other columns are not read. An added span never overlaps a base one; where two kinds claim a
    string, both are given.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("body"))
    seeds = shelf.keep(base_spans(texts))
    own = seeds.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    digits = F.char_length(F.regexp_replace("found", "[^0-9]", ""))
    others = _matches(texts, "other", OTHER).where((digits >= LEAST_DIGITS) & (F.char_length("found") >= 6)).unionByName(_matches(texts, "spelled", SPELLED))
    others = others.withColumn("kind", F.when(F.col("found").rlike(SECRET), "secret"))
    free = others.join(own.withColumnsRenamed({"id": "own_id", "th": "own_th"}), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")), "left")
    free = shelf.keep(free.where(F.coalesce(~F.exists("own", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])), F.lit(True))).drop("own", "own_id", "own_th"))
    added = shelf.keep(_bootstrap(seeds, free, shelf))
    place = F.array_position(F.array(*map(F.lit, (*KINDS, "secret"))), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), place.alias("kind_at"), "kind", "end", "added")
    spans = seeds.select("id", "th", "kind", "start", "end", F.lit(False).alias("added")).unionByName(added.withColumn("added", F.lit(True)))
    spans = spans.groupBy("id", "th").agg(F.array_sort(F.collect_list(span)).alias("spans")).withColumnsRenamed({"id": "s_id", "th": "s_th"})
    met = texts.select("id", "th").join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_at:int,kind:string,end:bigint,added:boolean>>"))
    return met.select(F.col("id").alias(id_col), F.filter(spans, lambda s: ~s["added"]).alias("base"), F.filter(spans, lambda s: s["added"]).alias("added"), spans.alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"), F.size("added").cast("long").alias("n_added"))
