"""Documents as tables: pages, terms on pages, quotes and where they stand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import cut, hinted


def pseudo_pages(documents: DataFrame, size: int = 3000) -> DataFrame:
    """Pages of `size` characters, numbered from 1; an empty text is one empty page."""
    text = F.coalesce("text", F.lit(""))
    last = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return documents.select("doc_id", text.alias("text"), F.explode(F.sequence(F.lit(1), last)).alias("page")).select("doc_id", "page", F.substring(F.col("text"), (F.col("page") - 1) * size + 1, F.lit(size)).alias("text"))


def chunk_pages(pages: DataFrame, max_chars: int = 60000, mark: int = 14) -> DataFrame:
    """Windows of consecutive pages, (doc_id, first, last), that share a page with the one before.

    A window takes pages while their characters, and `mark` more for each, stay within max_chars, one page at least. The
    next one starts at its last page, or after it where the window has no other. One fold per document, over page sizes.
    """
    sizes = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", (F.length("text") + mark).cast("long").alias("cost")))).alias("p"))

    def step(a: Column, p: Column) -> Column:
        window = lambda first: F.struct(first.alias("first"), a["last"].alias("last"))
        fits, alone = a["chars"] + p["cost"] <= max_chars, a["cost"] + p["cost"] > max_chars
        closed = F.when(fits, F.array().cast("array<struct<first:int,last:int>>")).when(alone & (a["first"] < a["last"]), F.array(window(a["first"]), window(a["last"]))).otherwise(F.array(window(a["first"])))
        again = ~alone & (a["first"] < a["last"])
        return F.struct(
            F.when(fits, a["first"]).when(again, a["last"]).otherwise(p["page"]).alias("first"), p["page"].alias("last"), p["cost"].alias("cost"),
            F.when(fits, a["chars"] + p["cost"]).when(again, a["cost"] + p["cost"]).otherwise(p["cost"]).alias("chars"), F.concat(a["out"], closed).alias("out"),
        )

    head = F.col("p")[0]
    start = F.struct(head["page"].alias("first"), head["page"].alias("last"), head["cost"].alias("cost"), head["cost"].alias("chars"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))
    windows = F.aggregate(F.slice("p", 2, F.size("p")), start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last")))))
    return sizes.select("doc_id", F.inline(windows))


def critical_terms(pages: DataFrame, pattern: str) -> DataFrame:
    """How often each match of the pattern, in lower case, stands on each page."""
    hits = pages.select("doc_id", "page", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term"))
    return hits.groupBy("doc_id", "page", "term").agg(F.count("*").alias("times"))


def one_space(text: Column) -> Column:
    """A text with runs of white space as one space and none at its ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _runs(words: Column, size: int, first: Column, last: Column) -> Column:
    """Hashes of the runs of `size` words that lie between the places first and last, from 0; none where there is no room."""
    run = lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)])
    return F.when(last - first + 1 >= size, F.transform(F.sequence(first, last - size + 1), run)).otherwise(F.array().cast("array<bigint>"))


def _standing(pairs: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(item_id, doc_id) whose text contains the quote."""
    held = cut(pairs.distinct().join(asked.select("item_id", "quote"), "item_id"))
    return hinted(held).join(texts, "doc_id").where(F.contains("text", F.col("quote"))).select("item_id", "doc_id")


def grounded_quotes(quotes: DataFrame, documents: DataFrame, most: int = 4) -> DataFrame:
    """quotes(item_id, text) with each document that contains one whole, white space aside: (item_id, doc_id).

    Containment has no equal key, so quotes meet documents by words. A quote's outer words may be parts of a document's
    words, the inner ones are whole: of its runs of up to `most` inner words the one that the fewest documents have is
    looked up, and what has it is checked for the whole quote. Documents' runs go no further than a semi-join with the
    quotes' own. A quote of one word is looked for within the distinct words of all documents, one of two words by the
    start of its second word, both by their first characters. A blank quote stands in every text, null ones in none.
    """
    asked = quotes.where("text is not null").select("item_id", one_space(F.col("text")).alias("quote")).withColumn("n", F.when(F.col("quote") == "", 0).otherwise(F.size(F.split("quote", " "))))
    texts = documents.where("text is not null").select("doc_id", one_space(F.col("text")).alias("text"))
    sizes = {r.n for r in asked.select(F.when(F.col("n") > 2, F.least(F.col("n") - 2, F.lit(most))).otherwise(-F.col("n")).alias("n")).distinct().collect()}  # most + 3 at most
    hashes = lambda c: F.transform(F.split(c, " "), lambda w: F.xxhash64(w))
    empty = F.array().cast("array<bigint>")
    found = []
    if lengths := sorted(s for s in sizes if s > 0):
        inner = asked.where("n > 2").select("item_id", "n", hashes(F.col("quote")).alias("h"))
        own = F.concat(empty, *[F.when(F.least(F.col("n") - 2, F.lit(most)) == s, _runs(F.col("h"), s, F.lit(1), F.col("n") - 2)).otherwise(empty) for s in lengths])
        runs = cut(inner.select("item_id", F.explode(F.array_distinct(own)).alias("key")))
        of_texts = texts.select("doc_id", hashes(F.col("text")).alias("h"))
        every = F.array_distinct(F.concat(empty, *[_runs(F.col("h"), s, F.lit(0), F.size("h") - 1) for s in lengths]))
        postings = cut(of_texts.select("doc_id", F.explode(every).alias("key")).join(hinted(runs.select("key").distinct()), "key", "left_semi"))
        held = runs.join(postings.groupBy("key").agg(F.count("*").alias("docs")), "key", "left")
        rarest = held.groupBy("item_id").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "key")).alias("x")).where("x.docs > 0")
        found.append(_standing(rarest.select("item_id", F.col("x.key").alias("key")).join(postings, "key").select("item_id", "doc_id"), asked, texts))
    if sizes & {-1, -2}:
        short = asked.where("n in (1, 2)").withColumn("part", F.element_at(F.split("quote", " "), -1)).withColumn("within", F.col("n") == 1)
        short = short.select("item_id", "part", "within", F.substring("part", 1, 3).alias("gram"))
        words = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word <> ''")
        grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.struct((i > 1).alias("inside"), F.substring(F.col("word"), i, F.lit(n)).alias("gram")))
        parts = F.array_distinct(F.flatten(F.array(*[F.when(F.length("word") >= n, grams(n)).otherwise(F.array().cast("array<struct<inside:boolean,gram:string>>")) for n in (1, 2, 3)])))
        met = words.select("word").distinct().select("word", F.inline(parts)).join(short, "gram")
        met = met.where(F.when(F.col("within"), F.contains("word", F.col("part"))).otherwise(~F.col("inside") & F.startswith("word", F.col("part")))).select("item_id", "word").distinct()
        found.append(_standing(met.join(words, "word").select("item_id", "doc_id"), asked, texts))
    if 0 in sizes:
        blank = asked.where("n = 0").agg(F.collect_set("item_id")).scalar()  # its result has each of them with every text
        found.append(texts.select(F.explode(blank).alias("item_id"), "doc_id"))
    nothing = asked.where("false").join(texts.select("doc_id"), F.lit(False)).select("item_id", "doc_id")
    return reduce(DataFrame.union, found).distinct() if found else nothing


# Phrases that tell of each family of terms, and the words that matter in a contract.
SIGNALS = {
    "commitment": ["minimum commitment", "committed", "shall pay no less than", "minimum monthly fee", "platform fee"], "usage": ["included", "in excess of", "overage", "per unit", "additional units", "tier"],
    "pricing_changes": ["increase", "escalat", "cpi", "anniversary", "discount", "promotional", "credit of", "expires"], "term": ["initial term", "renew", "automatically", "notice", "terminate", "effective date"],
}
CRITICAL = r"\b(?:renew\w*|notice|sixty|60|days?|commit\w*|minimum|seats?|licen[cs]\w*|fees?|rates?|prices?|overage|included|discount\w*|escalat\w*|refund\w*|credit\w*|rebate\w*|term|expires?|expiration)\b|[$€£%]"


def signal_recall(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Families whose signal phrases stand in a document that no term of the family was found in, and the pages to read again: found(doc_id, family)."""
    text = F.lower("text")
    family = lambda k, v: F.when(F.exists(F.array(*map(F.lit, v)), lambda p: F.contains(text, p)), F.lit(k))
    hits = pages.select("doc_id", "page", F.explode(F.array_compact(F.array(*[family(k, v) for k, v in SIGNALS.items()]))).alias("family"))
    return hits.groupBy("doc_id", "family").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("first_page")).join(found.select("doc_id", "family").distinct(), ["doc_id", "family"], "left_anti")


def quote_grounding(quotes: DataFrame, pages: DataFrame, most: int = 120) -> DataFrame:
    """quotes(item_id, doc_id, page, text) and where each stands: 'found' on its page, 're-anchored' on the first other page that has it, or 'missing'.

    The first `most` characters decide, as a quote's end is often cut off; `whole` says whether all of it stands on a
    page of the document. A blank quote is missing.
    """
    quote = one_space(F.col("text"))
    asked = quotes.select("item_id", "doc_id", F.col("page").alias("cited"), F.when(quote != "", quote).alias("quote"))
    held = asked.join(pages.select("doc_id", "page", one_space(F.col("text")).alias("text")), "doc_id").where(F.contains("text", F.substring("quote", 1, most)))
    best = held.groupBy("item_id").agg(F.min(F.struct(F.col("page") != F.col("cited"), F.col("page").alias("page"))).alias("x"), F.max(F.contains("text", F.col("quote"))).alias("whole"))
    state = F.when(F.col("x").isNull(), "missing").when(F.col("x.page") == F.col("cited"), "found").otherwise("re-anchored")
    return asked.join(best, "item_id", "left").select("item_id", "doc_id", state.alias("state"), F.col("x.page").alias("page"), F.coalesce("whole", F.lit(False)).alias("whole"))


def injection_audit(planted: DataFrame, constants: DataFrame) -> DataFrame:
    """Planted amounts that came through: planted(doc_id, value) that is one of the document's constants(doc_id, right_id, name, value, grounded), and constants without ground.

    A document's planted amounts are gathered first, and each constant has its faults in one pass.
    """
    of_doc = planted.where("doc_id is not null and value is not null").groupBy("doc_id").agg(F.collect_set("value").alias("planted"))
    rows = constants.join(of_doc.hint("merge"), "doc_id", "left")
    through = F.coalesce(F.array_contains("planted", F.col("value")), F.lit(False))
    faults = F.array_compact(F.array(F.when(through, "planted"), F.when(~F.col("grounded"), "ungrounded")))
    return rows.select("right_id", "name", F.explode(faults).alias("fault"))


def attach_documents(documents: DataFrame, masters: DataFrame) -> DataFrame:
    """documents(doc_id, refers: array of titles) to the master (master_id, title) that a reference names, the least id of several.

    A reference names a title if the words of one stand in the other in a row, in any case. Each distinct text meets
    those of the other side by its own word that the fewest of them have, one with a word that none of them has meets
    nothing, and what meets is checked; no reference is compared with every title, and copies of a text are looked up
    once. Blank titles and references name nothing.
    """
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    refs = documents.select("doc_id", F.explode("refers").alias("ref")).select("doc_id", key(F.col("ref")).alias("ref")).where("ref <> ''").distinct()
    titles = masters.select("master_id", key(F.col("title")).alias("title")).where("title <> ''").groupBy("title").agg(F.min("master_id").alias("master_id"))
    words = lambda rows, c: rows.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    of_refs, of_titles = cut(words(refs.select("ref").distinct(), "ref")), cut(words(titles, "title"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))

    def standing(inner: DataFrame, a: str, outer: DataFrame, b: str) -> DataFrame:
        often = outer.groupBy("word").agg(F.count("*").alias("n"))
        # estimates don't know how many words a text has, so none of these is broadcast by them
        counted = inner.join(often.hint("merge"), "word", "left").groupBy(a).agg(F.min(F.struct("n", "word")).alias("x"), F.bool_and(F.col("n").isNotNull()).alias("all"))
        rarest = counted.where("all").select(a, F.col("x.word").alias("word"))
        return rarest.join(outer.hint("merge"), "word").where(F.contains(pad(b), pad(a))).select("ref", "title")

    met = standing(of_refs, "ref", of_titles, "title").union(standing(of_titles, "title", of_refs, "ref"))
    best = met.join(titles.hint("merge"), "title").groupBy("ref").agg(F.min("master_id").alias("master_id"))
    return refs.join(best.hint("merge"), "ref").groupBy("doc_id").agg(F.min("master_id").alias("master_id"))


def clause_lookup(asked: DataFrame, clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """asked(customer_id, ref) with the contract's clause of that name, else the term's provenance."""
    rows = asked.join(clauses.select("customer_id", "ref", "clause"), ["customer_id", "ref"], "left").join(terms.select("customer_id", F.col("term_type").alias("ref"), "provenance"), ["customer_id", "ref"], "left")
    return rows.select("customer_id", "ref", F.coalesce(F.when(F.trim("clause") != "", F.col("clause")), "provenance").alias("text"))


def keyword_coverage(pages: DataFrame, blocks: DataFrame, pattern: str) -> DataFrame:
    """Matches on pages that their blocks lack, counted as a multiset."""
    words = lambda d: d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term"))
    return words(pages).exceptAll(words(blocks)).groupBy("doc_id", "term").agg(F.count("*").alias("missing"))
