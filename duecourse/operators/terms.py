"""Which term value holds at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .documents import attach_documents

MONEY = "decimal(18,2)"
DEFAULT = "__default__"


def _held(entries: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """panel(keys, period) with `value`, the last of entries(keys, effective, value, seq) by then, and `earliest`, the first of all.

    Entries and months go into one order per key, in which the last entry's value is carried on: one shuffle, no join of
    every month with every entry. An entry without a date holds from the beginning; of one date the first entry counts.
    """
    day = F.coalesce("effective", F.lit("0001-01-01").cast("date"))
    rows = entries.select(*keys, day.alias("day"), F.lit(0).alias("month"), "value", "seq").union(panel.select(*keys, F.col("period").alias("day"), F.lit(1), F.lit(None).cast(dict(entries.dtypes)["value"]), F.lit(None).cast("long")))
    order = Window.partitionBy(*keys).orderBy("day", "month", F.desc("seq"))
    first = F.min_by("value", F.when(F.col("month") == 0, F.struct("day", "seq"))).over(Window.partitionBy(*keys))
    rows = rows.withColumns({"held": F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "earliest": first})
    return rows.where("month = 1").select(*keys, F.col("day").alias("period"), F.col("held").alias("value"), "earliest")


def minimum_asof(schedule: DataFrame, panel: DataFrame) -> DataFrame:
    """panel(customer_id, period) with the minimum in force: the latest entry by period start, else the earliest of all."""
    return _held(schedule, panel, ["customer_id"]).select("customer_id", "period", F.coalesce("value", "earliest").alias("minimum")).where("minimum is not null")


def with_minimum(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """rows(customer_id, period, ...) with `minimum` as minimum_asof() gives it, null where there is no entry.

    The rows themselves go into the order of each customer's entries, so nothing is joined back.
    """
    kept = [c for c in rows.columns if c not in ("customer_id", "period", "minimum")]
    row = F.struct(*kept)
    day = F.coalesce("effective", F.lit("0001-01-01").cast("date"))
    mine = rows.select("customer_id", F.col("period").alias("day"), F.lit(1).alias("month"), F.lit(None).cast(dict(schedule.dtypes)["value"]).alias("value"), F.lit(None).cast("long").alias("seq"), row.alias("row"))
    both = schedule.select("customer_id", day.alias("day"), F.lit(0).alias("month"), "value", "seq", F.lit(None).cast(mine.schema["row"].dataType).alias("row")).union(mine)
    order = Window.partitionBy("customer_id").orderBy("day", "month", F.desc("seq"))
    first = F.min_by("value", F.when(F.col("month") == 0, F.struct("day", "seq"))).over(Window.partitionBy("customer_id"))
    held = F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("minimum", F.coalesce(held, first)).where("month = 1").select("customer_id", F.col("day").alias("period"), "row.*", "minimum")


def schedules(schedule: DataFrame) -> DataFrame:
    """schedule's entries by customer, for minimum_in(): customer_id, `held`, an array of (day, rank, value) in order, `earliest`, and `minimum`, the least value.

    A customer's entries are one contract's, so its months carry them instead of being put into one order with them.
    """
    day = F.coalesce("effective", F.lit("0001-01-01").cast("date"))
    entry = F.when(F.col("value").isNotNull(), F.struct(day.alias("day"), (-F.col("seq")).alias("rank"), "value"))
    return schedule.groupBy("customer_id").agg(F.sort_array(F.collect_list(entry)).alias("held"), F.min_by("value", F.struct(day, "seq")).alias("earliest"), F.min("value").alias("minimum"))


def minimum_in(period: Column) -> Column:
    """The minimum that minimum_asof() gives for a month, of schedules()."""
    return F.coalesce(F.try_element_at(F.filter("held", lambda x: x["day"] <= period), F.lit(-1))["value"], F.col("earliest"))


def governing(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, live, value): from each day on on which it may change, the entry of entries(keys, effective, ends, value, seq) that governs.

    A sweep per key over the days on which entries begin and on which they have ended: the live ones are held as a set,
    of which the one with the latest date, then the least seq, governs, an undated one last. live is false while there
    is none. An entry without a date holds from the beginning, one without an end for ever, one that ends before it
    begins never. A key's entries are one contract's, so a fold over an array of them holds little.
    """
    day, entry = F.coalesce("effective", F.lit("0001-01-01").cast("date")), "struct<dated:boolean,effective:date,rank:bigint,at:int,value:%s>" % dict(entries.dtypes)["value"]
    held = entries.where("effective is null or ends is null or ends >= effective").select(*keys, F.struct(day.alias("day"), F.date_add("ends", 1).alias("gone"), F.col("effective").isNotNull().alias("dated"), "effective", (-F.col("seq")).cast("long").alias("rank"), "value").alias("x"))
    of = lambda x, i: F.struct(x["dated"].alias("dated"), x["effective"].alias("effective"), x["rank"].alias("rank"), i.alias("at"), x["value"].alias("value"))
    moves = lambda column, begins: F.transform("every", lambda x, i: F.struct(x[column].alias("day"), F.lit(begins).alias("begins"), of(x, i).alias("entry")))
    events = F.array_sort(F.filter(F.concat(moves("day", True), moves("gone", False)), lambda e: e["day"].isNotNull()))
    changes = "array<struct<day:date,live:boolean,value:%s>>" % dict(entries.dtypes)["value"]

    def step(a: Column, e: Column) -> Column:
        live = F.when(e["begins"], F.array_append(a["live"], e["entry"])).otherwise(F.filter(a["live"], lambda x: x["at"] != e["entry"]["at"]))
        best = F.array_max(live)
        return F.struct(live.alias("live"), F.array_append(a["out"], F.struct(e["day"].alias("day"), best.isNotNull().alias("live"), best["value"].alias("value"))).alias("out"))

    start = F.struct(F.array().cast(f"array<{entry}>").alias("live"), F.array().cast(changes).alias("out"))
    swept = held.groupBy(*keys).agg(F.collect_list("x").alias("every")).select(*keys, F.aggregate(events, start, step, lambda a: a["out"]).alias("out"))
    return swept.select(*keys, F.posexplode("out").alias("at", "x")).select(*keys, "at", "x.*")


def active_terms(terms: DataFrame, panel: DataFrame, by: list[str]) -> DataFrame:
    """The latest entry by period start for each customer, month and `by`; none where all start later. A missing scope is a scope of its own.

    Terms with a column `ends` (null for open ones) hold through that day; an entry that has ended gives way to the
    latest that hasn't. Which one governs from which day on is swept out first, and carried to the months like open
    entries are; no month meets an entry that isn't its own.
    """
    named = terms.withColumn("scope", F.coalesce("scope", F.lit(DEFAULT))) if "scope" in by else terms
    months = panel.join(named.select("customer_id", *by).distinct(), "customer_id")
    if "ends" in terms.columns:
        keys = ["customer_id", *by]
        changes = governing(named, keys).select(*keys, "day", F.lit(0).alias("month"), "at", F.struct("live", "value").alias("state"))
        rows = changes.union(months.select(*keys, F.col("period").alias("day"), F.lit(1), F.lit(0), F.lit(None).cast(changes.schema["state"].dataType)))
        order = Window.partitionBy(*keys).orderBy("day", "month", "at").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("state", F.last("state", ignorenulls=True).over(order)).where("month = 1 and state.live")
        return rows.select("customer_id", F.col("day").alias("period"), *by, "state.value")
    return _held(named, months, ["customer_id", *by]).where("value is not null").drop("earliest")


def active_by_scope(terms: DataFrame, months: DataFrame, names: list[str]) -> DataFrame:
    """months(customer_id, period, ...), each once, with the customer's scopes and what active_terms() has for each of the terms
    `names` there, a column each; scopes without any such value are left out. The terms have no ends.

    A scope's entries are one contract's, so its months carry them instead of being put into one order with them: what is dealt
    by customer stays where it is, and nothing is pivoted or joined back.
    """
    named = terms.where(F.col("term").isin(names)).withColumn("scope", F.coalesce("scope", F.lit(DEFAULT)))
    more = [c for c in months.columns if c not in ("customer_id", "period")]
    day = F.coalesce("effective", F.lit("0001-01-01").cast("date"))
    entry = F.struct(day.alias("day"), (-F.col("seq")).alias("rank"), "value")
    of = lambda n: F.sort_array(F.collect_list(F.when((F.col("term") == n) & F.col("value").isNotNull(), entry))).alias(n)
    # dealt by customer at once, so that the grouping and the join are of one exchange
    held = named.repartition("customer_id").groupBy("customer_id", "scope").agg(*[of(n) for n in names])
    value = lambda n: F.try_element_at(F.filter(n, lambda x: x["day"] <= F.col("period")), F.lit(-1))["value"].alias(n)
    rows = months.join(held, "customer_id").select("customer_id", "period", "scope", *[value(n) for n in names], *more)
    return rows.where(F.coalesce(*names).isNotNull())


def active_minimums(schedule: DataFrame, panel: DataFrame) -> DataFrame:
    """The minimum of each scope that has begun by the month and not ended before it; no fallback. schedule has `ends`, null for open."""
    return active_terms(schedule, panel, ["scope"])


def resolve_scalar_terms(terms: DataFrame) -> DataFrame:
    """One value per customer and term type, or a conflict: several values on one date, undated ones counting as one date."""
    keys = ["customer_id", "term_type"]
    dated = terms.groupBy(*keys, "effective").agg(F.count_distinct("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    order = F.struct(F.col("effective").isNotNull(), "effective")
    each = dated.groupBy(*keys).agg(F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("low", order).alias("latest"))
    status = F.when(F.col("low") == F.col("high"), "single").when(F.col("most") > 1, "conflict").otherwise("latest")
    return each.select(*keys, status.alias("status"), F.when(status != "conflict", F.col("latest")).alias("value"))


def minimum_conflicts(terms: DataFrame) -> DataFrame:
    """Dates of a customer, type and scope on which different values compete."""
    once = terms.select("customer_id", "term_type", "scope", "effective", "value").distinct()
    groups = once.groupBy("customer_id", "term_type", "scope", "effective").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return groups.where("n > 1")


def term_state(terms: DataFrame, schedule: DataFrame) -> DataFrame:
    """What competing values leave of a contract's terms: customer_id, conflicts (an array of names), term_confidence (a map).

    terms(customer_id, term_type, effective, value, confidence) are scalar ones, schedule(customer_id, term_type, scope,
    effective, value, confidence) the minimums. A term without one value is a conflict and has no confidence, any other
    the least of its entries'; dates of a scope with several minimums, or undated ones beside dated ones, are a conflict
    of committed_minimum, whose confidence they leave.
    """
    sure = terms.groupBy("customer_id", "term_type").agg(F.min("confidence").alias("confidence"))
    each = resolve_scalar_terms(terms).join(sure, ["customer_id", "term_type"])
    bad = F.col("status") == "conflict"
    each = each.select("customer_id", F.col("term_type").alias("term"), bad.alias("bad"), F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"))
    several = minimum_conflicts(schedule).select("customer_id").union(undated_minimums(schedule).select("customer_id")).distinct().withColumn("bad", F.lit(True))
    least = schedule.groupBy("customer_id").agg(F.min("confidence").alias("confidence")).join(several, "customer_id", "left")
    each = each.union(least.select("customer_id", F.lit("committed_minimum"), F.coalesce("bad", F.lit(False)), "confidence"))
    return each.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.when(F.col("bad"), F.col("term")))).alias("conflicts"), F.map_from_entries(F.collect_list(F.struct("term", "confidence"))).alias("term_confidence"))


def undated_minimums(schedule: DataFrame) -> DataFrame:
    """Undated values of a scope that has dated ones: which of them holds is open, so they are left out of the schedule."""
    scopes = schedule.groupBy("customer_id", "scope").agg(F.count("effective").alias("dated")).where("dated > 0")
    return schedule.where("effective is null").join(scopes, ["customer_id", "scope"]).select("customer_id", "scope", "value").distinct()


def minimum_meta(schedule: DataFrame) -> DataFrame:
    """Where a customer's governing minimum, the latest, comes from, and the least confidence of all its entries."""
    return schedule.groupBy("customer_id").agg(F.max_by("source", F.struct(F.col("effective").isNotNull(), "effective", -F.col("seq"))).alias("source"), F.min("confidence").alias("confidence"))


def term_history(terms: DataFrame) -> DataFrame:
    """Every value that a term ever had, numbered by date; what comes twice counts once."""
    order = Window.partitionBy("customer_id", "term_type", "scope").orderBy(F.col("effective").asc_nulls_first(), "seq")
    return terms.withColumn("nth", F.row_number().over(order)).select("customer_id", "term_type", "scope", "nth", "effective", "value")


def dedupe_terms(terms: DataFrame, columns: list[str]) -> DataFrame:
    """Of terms equal in these columns the first by seq, whole."""
    return terms.groupBy(*columns).agg(F.min_by(F.struct(*terms.columns), "seq").alias("x")).select("x.*")


def apply_resolutions(terms: DataFrame, conflicts: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms with each conflicting date's values replaced by the chosen one, and the conflicts that nobody has decided.

    conflicts and choices(chosen) are by customer_id, term_type, scope and effective.
    """
    keys = ["customer_id", "term_type", "scope", "effective"]
    decided = choices.join(conflicts.select(keys), keys, "left_semi")
    rows = terms.join(decided.select(*keys, "chosen"), keys, "left").where("chosen is null or value = chosen")
    return dedupe_terms(rows.drop("chosen"), [*keys, "value"]), conflicts.join(decided, keys, "left_anti")


def assemble_agreements(documents: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One agreement per counterparty: governing terms, the documents' places in it, and reviews.

    documents(doc_id, counterparty, role, dated), terms(doc_id, seq, term_type, scope, effective, value). The latest
    master governs, older ones are superseded; without a master the earliest dated document anchors. Dated amendments
    override in order of date, undated ones are flagged and not applied. Order forms, exhibits and statements of work
    fill gaps; where they disagree with the anchor a review says so. Terms with a scope accumulate. Of amendments of one
    date the one of the highest number governs, where documents have a number.
    """
    per = Window.partitionBy("counterparty")
    master = F.max(F.when(F.col("role") == "master", F.struct(F.col("dated").isNotNull(), "dated", -F.col("doc_id")))).over(per)
    oldest = F.min(F.when(F.col("dated").isNotNull(), F.struct("dated", "doc_id"))).over(per)
    docs = documents.withColumns({"master": -master["col3"], "oldest": oldest["doc_id"]})
    anchor = F.coalesce("master", "oldest")
    place = F.when(F.col("doc_id") == anchor, "anchor").when(F.col("role") == "master", "superseded").when((F.col("role") == "amendment") & F.col("dated").isNull(), "undated").when(F.col("role") == "amendment", "amendment").otherwise("supplement")
    number = F.col("number").cast("int") if "number" in documents.columns else F.lit(None).cast("int")
    docs = docs.select("doc_id", "counterparty", "role", "dated", number.alias("number"), place.alias("place"))
    rows = terms.join(docs, "doc_id")
    rank = F.when(F.col("place") == "amendment", 0).when(F.col("place") == "anchor", 1).when(F.col("place") == "supplement", 2)
    live = rows.where("place not in ('superseded', 'undated')").withColumn("rank", rank)
    order = Window.partitionBy("counterparty", "term_type").orderBy("rank", F.when(F.col("rank") == 0, F.col("dated")).desc_nulls_last(), F.when(F.col("rank") == 0, F.col("number")).desc_nulls_last(), "doc_id", "seq")
    plain = live.where("scope is null").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    kept = plain.select("counterparty", "term_type", "scope", "effective", "value", "doc_id").union(live.where("scope is not null").select("counterparty", "term_type", "scope", "effective", "value", "doc_id"))
    held = live.where("place = 'anchor' and scope is null").groupBy("counterparty", "term_type").agg(F.min_by("value", "seq").alias("own"))
    differ = live.where("place = 'supplement' and scope is null").join(held, ["counterparty", "term_type"]).where("value <> own").select("counterparty", "doc_id", F.concat(F.lit("disagrees on "), "term_type").alias("reason"))
    flagged = docs.where("place in ('superseded', 'undated')").select("counterparty", "doc_id", F.when(F.col("place") == "undated", "undated amendment").otherwise("superseded").alias("reason"))
    return kept, docs, differ.union(flagged).distinct()


def assemble_by_references(documents: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """assemble_agreements() for documents(doc_id, counterparty, title, role, dated, executed, number, refers) of which some name no counterparty.

    Such a document goes to the agreement of the master whose title one of its references names, of several that of the
    least doc_id; one that names none is an agreement of its own, with a review. A document without a date has that of
    its execution. The agreements' keys are the counterparties as text, or 'document' and the doc_id.
    """
    masters = documents.where("counterparty is not null and role = 'master' and title is not null")
    found = attach_documents(documents.where("counterparty is null").select("doc_id", "refers"), masters.select(F.col("doc_id").alias("master_id"), "title"))
    found = found.join(masters.select(F.col("doc_id").alias("master_id"), F.col("counterparty").alias("named")), "master_id").select("doc_id", "named")
    docs = documents.join(found, "doc_id", "left")
    alone = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", F.coalesce(F.col("counterparty").cast("string"), F.col("named").cast("string"), alone).alias("counterparty"), "role", F.coalesce("dated", "executed").alias("dated"), "number", (F.col("counterparty").isNull() & F.col("named").isNull()).alias("alone"))
    kept, places, reviews = assemble_agreements(docs, terms)
    return kept, places, reviews.union(docs.where("alone").select("counterparty", "doc_id", F.lit("no agreement found")))


def tier_bands(tiers: DataFrame) -> DataFrame:
    """tiers(rule, up_to, rate) with each band's lower bound; an open band comes last."""
    order = Window.partitionBy("rule").orderBy(F.col("up_to").asc_nulls_last())
    return tiers.withColumn("lower", F.coalesce(F.lag("up_to").over(order), F.lit(0).cast("decimal(18,2)")))


def tiered_amount(quantities: DataFrame, tiers: DataFrame) -> DataFrame:
    """quantities(key, rule, units) priced band by band; units above the last bound aren't charged."""
    rows = quantities.join(tier_bands(tiers), "rule")
    part = F.greatest(F.least("units", F.coalesce("up_to", "units")) - F.least("units", F.col("lower")), F.lit(0).cast("decimal(18,2)"))
    return rows.groupBy("key", "rule").agg(F.sum(part * F.col("rate")).cast("decimal(18,2)").alias("amount"))


def renewal_calendar(contracts: DataFrame, today: str, notice_days: int = 60) -> DataFrame:
    """Each contract's notice deadline and state on a day, in the order to look at them: deadline, then end, unknown last."""
    day, deadline = F.lit(today).cast("date"), F.date_sub("term_end", notice_days)
    state = F.when(F.col("term_end").isNull(), "unknown").when(F.col("term_end") < day, "expired").when(deadline <= day, "notice_window_open").when(F.datediff(deadline, day) <= 90, "upcoming_90d").otherwise("later")
    return contracts.select("customer_id", "term_end", deadline.alias("notice_deadline"), state.alias("state"))
