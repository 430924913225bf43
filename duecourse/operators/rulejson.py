"""Rules from JSON text: the nested trigger, the calculation and the constants as columns of the rule language, and what is wrong with a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rightspec as R

# How deep a trigger may nest, and the keys of a rule and its parts.
MAX_DEPTH = 8
RULE_KEYS = [
    "spec_version", "right_id", "right_family", "holder_party_id", "obligor_party_id", "trigger", "calculation", "required_observations", "contractual_constants", "currency",
    "effective_from", "effective_until", "evidence_refs", "actual_observation", "actual_observation_optional",
]
NODE_KEYS = ["op", "observation", "value", "low", "high", "children"]
CALC_KEYS = ["type", "amount", "rate", "base_observation", "quantity_observation", "above", "minuend", "subtrahend", "floor_zero", "tiers", "cap", "floor", "operands", "band_observation", "bands"]
CONSTANT_KEYS = ["name", "value", "kind", "currency", "evidence_ref"]


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))


def parse_rules(specs: DataFrame) -> DataFrame:
    """specs(customer_id, quote, spec) to rules of the rule language, with `faults`, what the text itself has wrong.

    A trigger is unfolded a level at a time down to MAX_DEPTH; what nests deeper is a fault and left out. Unknown keys
    anywhere, a test of dates against a constant that isn't one, and a text that isn't JSON are faults. A percentage is
    written as in the contract and held as a rate. A null spec isn't JSON; of constants with one name the first counts.
    """
    node = lambda path, parent, v: F.struct(path.alias("path"), parent.alias("parent"), v.alias("node"))
    rows = specs.select("customer_id", "quote", F.try_parse_json("spec").alias("v")).withColumns({"trigger": _at(F.col("v"), "trigger", "variant"), "calculation": _at(F.col("v"), "calculation", "variant"), "constant": _list(F.col("v"), "contractual_constants")})
    root = F.array(node(F.lit("0"), F.lit(None).cast("string"), F.col("trigger")))
    rows = rows.withColumn("level_0", F.when(F.col("trigger").isNotNull(), root).otherwise(F.filter(root, lambda _: F.lit(False))))
    for k in range(1, MAX_DEPTH + 1):
        below = lambda n: F.transform(_list(n["node"], "children"), lambda c, i: node(F.concat(n["path"], F.lit("."), i.cast("string")), n["path"], c))
        rows = rows.withColumn(f"level_{k}", F.flatten(F.transform(f"level_{k - 1}", below)))
    rows = rows.withColumn("every", F.concat(*[F.col(f"level_{k}") for k in reversed(range(MAX_DEPTH))])).withColumn("paths", F.transform("every", lambda n: n["path"]))
    number = lambda path: F.when(path.isNotNull(), F.array_position("paths", path)).cast("int")
    nodes = F.transform("every", lambda n: F.struct(number(n["path"]).alias("id"), number(n["parent"]).alias("parent"), _at(n["node"], "op").alias("op"), _at(n["node"], "observation").alias("observation"), *[_at(n["node"], f"{k}.constant").alias(k) for k in ("value", "low", "high")]))
    c = F.col("calculation")
    names = {k: _at(c, f"{k}.constant") for k in ("amount", "rate", "above", "cap", "floor")} | {k: _at(c, f"{k}_observation") for k in ("base", "quantity", "band")}
    names |= {k: F.coalesce(_at(c, f"{k}.constant"), _at(c, f"{k}.observation")) for k in ("minuend", "subtrahend")}
    tiers = F.transform(F.concat(_list(c, "tiers"), _list(c, "bands")), lambda t: F.struct(_at(t, "up_to.constant").alias("up_to"), _at(t, "rate.constant").alias("rate")))
    operands = F.transform(_list(c, "operands"), lambda o: F.struct(_at(o, "constant").alias("constant"), _at(o, "observation").alias("observation")))
    parts = names | {"type": F.coalesce(_at(c, "type"), F.lit("none")), "floor_zero": F.coalesce(_at(c, "floor_zero", "boolean"), F.lit(True)), "tiers": tiers, "operands": operands}
    order = "type amount rate base quantity above band minuend subtrahend floor_zero cap floor tiers operands".split()
    value = lambda x: F.regexp_replace(_at(x, "value"), r"[$,%\s]", "").try_cast(R.NUMBER)
    return _with_faults(rows.withColumns({
        "right_id": _at(F.col("v"), "right_id"), "currency": F.coalesce(_at(F.col("v"), "currency"), F.lit("USD")), "nodes": nodes.cast(R.NODES),
        "calc": F.struct(*[parts[k].alias(k) for k in order]).cast(R.CALC), "named": F.transform("constant", lambda x: F.struct(_at(x, "name").alias("name"), _at(x, "kind").alias("kind"), F.when(_at(x, "kind") == "percentage", value(x) / 100).otherwise(value(x)).cast(R.NUMBER).alias("number"), _at(x, "value").try_cast("date").alias("date"))),
        "actual": _at(F.col("v"), "actual_observation"), "actual_optional": F.coalesce(_at(F.col("v"), "actual_observation_optional", "boolean"), F.lit(False)), "required": F.coalesce(_at(F.col("v"), "required_observations", "array<string>"), F.array().cast("array<string>")),
    }))


def _with_faults(rows: DataFrame) -> DataFrame:
    """The rule's columns and its faults; constants as maps, dates apart."""
    rows = rows.withColumn("names", F.transform("named", lambda x: x["name"]))
    rows = rows.withColumn("named", F.filter("named", lambda e, i: (F.array_position("names", e["name"]) == i + 1) & e["name"].isNotNull()))
    of = lambda test, field: F.map_from_entries(F.transform(F.filter("named", test), lambda e: F.struct(e["name"], e[field])))
    rows = rows.withColumns({"constants": of(lambda e: e["kind"] != "date", "number"), "dates": of(lambda e: e["kind"] == "date", "date")})
    extra = F.concat(
        F.array_except(_keys(F.col("v")), F.array(*map(F.lit, RULE_KEYS))), F.array_except(_keys(F.col("calculation")), F.array(*map(F.lit, CALC_KEYS))),
        F.flatten(F.transform("every", lambda n: F.array_except(_keys(n["node"]), F.array(*map(F.lit, NODE_KEYS))))), F.flatten(F.transform("constant", lambda x: F.array_except(_keys(x), F.array(*map(F.lit, CONSTANT_KEYS))))),
    )
    undated = F.filter("nodes", lambda n: n["op"].isin(R.DATE_TESTS) & n["value"].isNotNull() & ~F.map_contains_key("dates", n["value"]) & F.map_contains_key("constants", n["value"]))
    faults = F.when(F.col("v").isNull(), F.array(F.lit("not JSON"))).otherwise(F.concat(
        F.transform(F.sort_array(F.array_distinct(extra)), lambda k: F.concat(F.lit("unknown key "), k)), F.when(F.size(f"level_{MAX_DEPTH}") > 0, F.array(F.lit("too many levels"))).otherwise(F.array().cast("array<string>")),
        F.array_distinct(F.transform(undated, lambda n: F.concat(F.lit("no date "), n["value"]))),
    ))
    return rows.select("right_id", "customer_id", "currency", "quote", "constants", "dates", "nodes", "calc", "actual", "actual_optional", "required", faults.alias("faults"))


def validate_texts(rules: DataFrame) -> DataFrame:
    """validate_rules() of parse_rules(), with the faults of the texts among the reasons; a text that isn't JSON has no other."""
    rows = rules.select("customer_id", "right_id", "faults", R.rule_faults().alias("own"))
    broken = F.array_contains("faults", "not JSON")
    reasons = F.when(broken, F.col("faults")).otherwise(F.concat("faults", "own"))
    rows = rows.select("customer_id", "right_id", reasons.alias("reasons"))
    status = F.when(F.size("reasons") == 0, "valid").when(F.exists("reasons", lambda r: r.startswith("unknown")), "unsupported").when(F.exists("reasons", lambda r: r.startswith("too many") | (r == "not JSON")), "rejected").otherwise("needs_review")
    return rows.select("customer_id", "right_id", status.alias("status"), F.array_join("reasons", "; ").alias("reasons"))
