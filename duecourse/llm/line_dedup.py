"""Line dedup by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, free, small, staged

#: Leading words on the path from the root to a leaf, below the level of the word count.
DEPTH = 2
#: Of a line's words so many in a hundred must be the template's own, and all where there are no more than LEAST_OWN.
OWN_PERCENT = 75
LEAST_OWN = 4
#: A template recurs when it comes from so many documents.
MIN_DOCS = 8
#: A word is a template's own at a place of a leaf when so many documents have it there: from MIN_DOCS on in steps of 4.
STEPS = 14


def _cleaned(rows: DataFrame, column: str) -> DataFrame:
    """rows with texts whose lines have their words joined by one space; a word with a digit becomes <*>. Null becomes empty.

    Each rewriting passes over those texts only that need it.
    """
    c = F.col(column)
    has = lambda *marks: reduce(or_, [F.contains(c, F.lit(m)) for m in marks])
    given = rows.withColumn(column, F.coalesce(c, F.lit("")))
    spaced = given.withColumn(column, F.when(has("\t", "\x0b", "\x0c", "\r"), F.translate(c, "\t\x0b\x0c\r", "    ")).otherwise(c))
    single = spaced.withColumn(column, F.when(has("  "), F.regexp_replace(c, "  +", " ")).otherwise(c))
    tight = single.withColumn(column, F.trim(F.when(has(" \n", "\n "), F.regexp_replace(c, " ?\n ?", "\n")).otherwise(c)))
    return tight.withColumn(column, F.when(c.rlike("[0-9]"), F.regexp_replace(c, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")).otherwise(c))


def leaf_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, context, leaf, words): a row per line with a letter, and its leaf in the tree.

    The path to a leaf is the word count and the DEPTH leading words; context hashes the whole cleaned text. A null or
    empty text has no lines; repeated rows give repeated lines.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").alias("clean"))
    rows = _cleaned(rows, "clean").select("doc_id", "text_key", F.xxhash64("clean").alias("context"), F.posexplode(F.split("clean", "\n")).alias("line", "words")).where(F.col("words").rlike(r"\p{L}"))
    tokens = F.split("words", " ")
    return rows.select("doc_id", "text_key", "line", "context", F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH)).alias("leaf"), "words")


def _from_many(rows: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """keys with `docs` and `first`, the number of documents and the least one, of those from at least min_docs.

    Of equal cleaned texts only that of the least doc_id counts, so copies of a whole text don't make its lines recur:
    those are for near-duplicate and substring dedup.
    """
    once = rows.groupBy(*keys, "context").agg(F.min("doc_id").alias("doc_id"))
    return once.groupBy(*keys).agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)


def _tokens(lines: DataFrame, *kept: str) -> DataFrame:
    """A row per word of each line: the kept columns and token, a hash of its leaf, place and word."""
    rows = lines.select(*{*kept, "leaf"}, F.posexplode(F.split("words", " ")).alias("place", "word"))
    return rows.select(*kept, F.xxhash64("leaf", "place", F.xxhash64("word")).cast("long").alias("token"))


def _often(wide: DataFrame, min_docs: int) -> DataFrame:
    """(token, step): the words that enough documents have at a place of a leaf, and the last step at which these are enough.

    A text's equal lines count once and its lines of a leaf meet before they become words, so of these only sums per
    token are shuffled. Documents are counted as texts by their least doc_id, unless some doc_id has several such texts.
    """
    first = wide.groupBy("context").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    single = first.groupBy("doc_id").count().where("count > 1").isEmpty()
    once = wide.groupBy("context", "leaf", "words").agg(F.min("doc_id").alias("doc_id")).repartition("context", "leaf")
    each = _tokens(once, "context", "leaf", "doc_id").groupBy("context", "leaf", "token").agg(F.min("doc_id").alias("doc_id"))
    docs = each.groupBy("token").agg((F.count("doc_id") if single else F.count_distinct("doc_id")).alias("docs")).where(F.col("docs") >= min_docs)
    steps = [F.when(F.col("docs") >= min_docs * 4**k, 1).otherwise(0) for k in range(1, STEPS)]
    return docs.select("token", reduce(add, steps).cast("long").alias("step"))


def templates(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, line, context, template) of lines(doc_id, text_key, line, context, leaf, words) in leaves from at least min_docs documents.

    Lines of a leaf merge where they share enough words at the same places: a word that enough documents have at its
    place is the template's own, any other is a variable field. Enough is min_docs, and four times that, and so on: a
    frequent value of a field is the template's own at first and becomes variable later. Each step at which OWN_PERCENT
    of a line's words are the template's own gives the line a template. Words at their places are known by 60-bit hashes.
    """
    # enough lines aren't yet enough documents, but fewer can't be: whether a word has enough is counted below
    leaves = staged(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    wide = staged(lines.join(small(leaves), "leaf").withColumn("key", F.monotonically_increasing_id()), "wide")
    often = staged(_often(wide, min_docs), "often")
    own = _tokens(wide, "key", "leaf").join(small(often), "token")
    # a word's token with its step in the last four bits, so that a line's words are numbers and not rows of their own
    own = own.groupBy("key").agg(F.sort_array(F.collect_list(F.col("token").bitwiseAND(F.lit(~15)).bitwiseOR(F.col("step")))).alias("own"))  # at most a line's words
    n = F.size(F.split("words", " "))
    need = F.greatest(F.ceil(n * OWN_PERCENT / 100), F.least(n, F.lit(LEAST_OWN)))
    step = lambda w: w.bitwiseAND(F.lit(15)).cast("int")
    kept = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("own", step))), lambda k: F.transform(F.filter("own", lambda w: step(w) >= k), lambda w: w.bitwiseAND(F.lit(~15))))
    held = F.array_distinct(F.transform(F.filter(kept, lambda x: F.size(x) >= need), lambda x: F.xxhash64(F.col("leaf"), x)))
    out = staged(wide.join(own, "key").select("doc_id", "text_key", "line", "context", F.explode(held).alias("template")), "templates")
    discard(leaves, wide, often)
    return out


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines of recurring templates dropped from `text`, but in the first document that has the template.

    Adds lines_before and lines_dropped (replacing columns of that name); all other columns stay. A null text stays
    null with no lines dropped; lines without a letter stay; a document may be left with an empty text.
    A row with a null doc_id is not counted, and loses recurring lines; repeated rows are treated alike; an empty table
    stays empty.
    """
    lines = staged(leaf_lines(docs), "lines")
    found = templates(lines, min_docs)
    discard(lines)
    first = staged(_from_many(found, ["template"], min_docs).select("template", "first"), "first")
    hits = found.join(small(first), "template").where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first")))
    drop = staged(hits.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("drop")), "drop")
    discard(found, first)
    rows = docs.drop("lines_before", "lines_dropped")
    at, key, gone = free(rows.columns, "row_at", "row_key", "row_drop")
    drop = drop.select(F.struct("doc_id", "text_key").alias(key), F.col("drop").alias(gone))
    rows = rows.withColumn(at, F.struct(F.col("doc_id").cast("long"), F.xxhash64("text")))
    rows = rows.join(small(drop), F.col(at).eqNullSafe(F.col(key)), "left").drop(at, key)
    lines_of = F.split("text", "\n")
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines_of, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    size = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return rows.withColumns({"lines_before": size(lines_of), "lines_dropped": size(F.col(gone))}).withColumn("text", kept).drop(gone)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "lines_before", "lines_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB, for a table whose doc_ids are unique.
LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM {{docs}}),
clean AS (
  SELECT doc_id, line, raw, list_transform(string_split(trim(regexp_replace(regexp_replace(raw, '[\\t\\x0B\\f\\r]', ' ', 'g'), ' +', ' ', 'g'), ' '), ' '),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM lines),
texts AS (SELECT doc_id, md5(string_agg(array_to_string(tokens, ' '), chr(10) ORDER BY line)) AS context FROM clean GROUP BY doc_id),
held AS (
  SELECT doc_id, line, context, tokens, len(tokens) AS n, tokens[1:{DEPTH}] AS lead FROM clean JOIN texts USING (doc_id) WHERE regexp_matches(array_to_string(tokens, ' '), '\\pL')),
leaves AS (
  SELECT n, lead FROM (SELECT n, lead, context, min(doc_id) AS doc_id FROM held GROUP BY ALL) GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
wide AS (SELECT h.* FROM held h JOIN leaves USING (n, lead)),
words AS (SELECT doc_id, line, context, n, lead, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS place FROM wide),
often AS (
  SELECT n, lead, place, word, count(DISTINCT doc_id) AS docs FROM (SELECT n, lead, place, word, context, min(doc_id) AS doc_id FROM words GROUP BY ALL) GROUP BY ALL HAVING docs >= {MIN_DOCS}),
own AS (
  SELECT doc_id, line, context, n, lead, step, list(struct_pack(place, word) ORDER BY place) AS template
  FROM words JOIN often USING (n, lead, place, word), (SELECT unnest([{", ".join(str(MIN_DOCS * 4**k) for k in range(STEPS))}]) AS step) WHERE docs >= step GROUP BY ALL),
taken AS (SELECT DISTINCT doc_id, line, context, n, lead, template FROM own WHERE len(template) >= greatest(ceil(n * {OWN_PERCENT} / 100), least(n, {LEAST_OWN}))),
once AS (SELECT n, lead, template, context, min(doc_id) AS doc_id FROM taken GROUP BY ALL),
first AS (SELECT n, lead, template, min(doc_id) AS first FROM once GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
hits AS (SELECT DISTINCT t.doc_id, t.line FROM taken t JOIN first f USING (n, lead, template) WHERE t.doc_id <> f.first),
done AS (
  SELECT l.doc_id, count(*) AS lines_before, count(h.line) AS lines_dropped, coalesce(string_agg(CASE WHEN h.line IS NULL THEN raw END, chr(10) ORDER BY l.line), '') AS text
  FROM lines l LEFT JOIN hits h ON l.doc_id = h.doc_id AND l.line = h.line GROUP BY l.doc_id)
"""

ORACLE = LINE_DEDUP_SQL.format(docs="documents") + "SELECT doc_id, lines_before, lines_dropped, sha256(text) AS kept_sha256 FROM done"
