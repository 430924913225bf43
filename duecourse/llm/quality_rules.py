"""Document quality rules with thresholds taken from quantile sketches per language and source; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, small, staged, words

#: Ratio of each rule and the least spread that counts, so that a group without variation rejects nothing close by.
RULES = {"symbols": 0.02, "dup_lines": 0.1, "repeats": 0.04, "word_length": 0.75}
#: Rules that also bound from below.
TWO_SIDED = {"word_length"}
#: How many spreads (upper less lower quartile) beyond a quartile is too far.
SPREADS = 4.0
#: A group's quartiles count as those of its documents and so many more that are like its parent's: a source's group in a
#: language leans on the language, the language on all. So thresholds change smoothly with a group's size.
LEAN = 200
#: Accuracy of the sketches: their rank error is at most 1 / ACCURACY.
ACCURACY = 2000
QUARTILES = [0.25, 0.75]


def base_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) to doc_id, lang, source, n_lines and the base counts, computed on whole texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^" + SPACE[1:]))
    rows = rows.select(
        "doc_id", "lang", "source", words(F.col("text")).alias("words"), lines.alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    grams = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(5)]))
    rows = rows.withColumn("grams", F.when(F.col("n_words") >= 5, grams).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    # only texts in which a window occurs twice look for where
    sortable = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.sort_array(sortable)).drop("grams")
    same = lambda i, j: F.get("sorted", i)["g"].eqNullSafe(F.get("sorted", j)["g"])
    twice = F.filter(F.transform("sorted", lambda s, i: F.when(same(i, i - 1) | same(i, i + 1), s["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", F.sort_array(twice)).drop("sorted")
    # a window covers five words, less where the next one starts sooner
    covered = F.aggregate(F.transform("starts", lambda s, i: F.least(F.lit(5), F.coalesce(F.get("starts", i + 1) - s, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")}


def quartiles(counts: DataFrame) -> DataFrame:
    """(g_lang, g_source, level, docs, <rule>: both quartiles) of each language and source, each language, and all.

    One pass of quantile sketches, merged map-side first; the levels are grouping sets. Documents without words don't count.
    """
    held = counts.where("n_words > 0").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[c.alias(k) for k, c in ratios().items()])
    sets = held.groupingSets([["g_lang", "g_source"], ["g_lang"], []], "g_lang", "g_source")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("docs"), *[F.percentile_approx(k, QUARTILES, ACCURACY).alias(k) for k in RULES])


def thresholds(table: DataFrame) -> DataFrame:
    """(g_lang, g_source, bound: <rule>_low and <rule>_high) from quartiles(), a row per language and source.

    Each group's quartiles lean on its parent's, see LEAN; the fences lie SPREADS spreads beyond them.
    """
    named = lambda level, name: table.where(F.col("level") == level).select(F.col("g_lang").alias(f"{name}_lang"), F.col("g_source").alias(f"{name}_source"), F.struct(F.col("docs").cast("double").alias("docs"), *RULES).alias(name))
    everything = table.where("level = 3").agg(F.first(F.struct(*RULES))).scalar()
    rows = named(0, "own").join(small(named(1, "of").drop("of_source")), F.col("own_lang").eqNullSafe(F.col("of_lang"))).withColumn("every", everything)  # a row per language
    lean = lambda n, q, parent: (n * q + parent * float(LEAN)) / (n + float(LEAN))
    bounds = []
    for k, least in RULES.items():
        low, high = (lean(F.col("own.docs"), F.col(f"own.{k}")[i], lean(F.col("of.docs"), F.col(f"of.{k}")[i], F.col(f"every.{k}")[i])) for i in (0, 1))
        spread = F.greatest(high - low, F.lit(least)) * SPREADS
        bounds += [(low - spread).alias(f"{k}_low"), (high + spread).alias(f"{k}_high")]
    return rows.select(F.col("own_lang").alias("g_lang"), F.col("own_source").alias("g_source"), F.struct(*bounds).alias("bound"))


def judge(counts: DataFrame) -> DataFrame:
    """counts (staged) with base_failed, failed_rules and kept.

    A document takes the thresholds of its language and source; null languages and sources are groups of their own.
    """
    table = staged(thresholds(staged(quartiles(counts), "quartiles")), "thresholds")
    rows = counts.join(small(table), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")
    failed = []
    for k, c in ratios().items():
        out = c > F.col(f"bound.{k}_high")
        failed.append(F.when(out | (c < F.col(f"bound.{k}_low")) if k in TWO_SIDED else out, F.lit(k)))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = rows.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*failed))})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("bound")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Judges every row of docs(doc_id, text, lang, source): base counts, base_failed, failed_rules, kept.

    A null text has no words and fails the base rule; rows with null doc_id are judged as others; repeated rows get
    equal verdicts; an empty table gives no rows; further columns are ignored.
    """
    return judge(staged(base_counts(docs), "counts"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


_WORD = r"[^\x20\x09-\x0D]+"
_RATIOS = {"symbols": "CAST(n_symbols AS DOUBLE) / greatest(word_chars, 1)", "dup_lines": "CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1)", "repeats": "CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1)", "word_length": "CAST(word_chars AS DOUBLE) / greatest(n_words, 1)"}
_AT = ", ".join(f"quantile_disc({c}, {q}) AS {k}_{i}" for k, c in _RATIOS.items() for i, q in enumerate(QUARTILES))
_LEANT = ", ".join(f"(o.docs * o.{k}_{i} + ((g.docs * g.{k}_{i} + e.{k}_{i} * {LEAN}.0::DOUBLE) / (g.docs + {LEAN}.0::DOUBLE)) * {LEAN}.0::DOUBLE) / (o.docs + {LEAN}.0::DOUBLE) AS {k}_{i}" for k in RULES for i in (0, 1))
_SPREAD = "greatest({0}_1 - {0}_0, {1}::DOUBLE) * " + f"{SPREADS}::DOUBLE"
_FAILED = ", ".join(f"CASE WHEN {_RATIOS[k]} > {k}_1 + {_SPREAD.format(k, least)}" + (f" OR {_RATIOS[k]} < {k}_0 - {_SPREAD.format(k, least)}" if k in TWO_SIDED else "") + f" THEN '{k}' END" for k, least in RULES.items())
#: The same in DuckDB, for a table whose doc_ids are unique; its quantiles are exact, as the sketches' are on so few rows.
ORACLE = f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM docs WHERE len(words) >= 5),
hashed AS (SELECT doc_id, i, words[i:i + 4] AS g FROM grams),
twice AS (SELECT doc_id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, sum(least(5, coalesce(next - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM docs),
counts AS (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM docs JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
marks AS (SELECT lang, source, grouping_id(lang, source) AS level, CAST(count(*) AS DOUBLE) AS docs, {_AT} FROM counts WHERE n_words > 0 GROUP BY GROUPING SETS ((lang, source), (lang), ())),
bounds AS (SELECT o.lang AS g_lang, o.source AS g_source, {_LEANT} FROM marks o JOIN marks g ON g.level = 1 AND o.lang IS NOT DISTINCT FROM g.lang JOIN marks e ON e.level = 3 WHERE o.level = 0),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {_FAILED}) AS failed_rules FROM counts LEFT JOIN bounds ON lang IS NOT DISTINCT FROM g_lang AND source IS NOT DISTINCT FROM g_source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM judged
"""
