"""Quality rules checked again by difference.

What a rule flags is stored as bitmaps over row numbers, one folder per fingerprint of the rule, one bitmap per 32,768 rows.
When a rule set is applied again, only rules without a stored fingerprint are evaluated; the others are read from their
bitmaps. A changed message needs no evaluation, for it does not change what is flagged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulemill.functions.columns import column
from rulemill.operators.quality import quality_condition
from rulemill.plans.rules import Rule, Rules, as_rules, check_quality, quality_rule_applies
from rulemill.sources.storage import listed_names

STORED = "fingerprint string, bucket long, bits binary"
_FOLDER = "fingerprint="
#: The bucket of a row that only says that a rule has been evaluated.
_KNOWN = -1


def fingerprint(rule: Rule) -> str:
    """The same for rules that flag the same cells of any table."""
    parts = [rule["attribute"], rule["type"], "yes" if rule["not"] == "yes" else "no", rule["condition"], rule["value"]]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]


def known_fingerprints(spark: SparkSession, path: str) -> set[str]:
    """Of the rules whose findings are stored; names of folders only."""
    return {n[len(_FOLDER) :] for n in listed_names(spark, path) if n.startswith(_FOLDER)}


def usable_rules(df: DataFrame, rules: Rules) -> dict[str, list[Rule]]:
    """fingerprint -> the rules that have it, in rule order; wrong rules are left out."""
    listed = as_rules(rules, "quality")
    bad = {n for n, _, _ in check_quality(listed, df.columns)}
    out: dict[str, list[Rule]] = {}
    for rule in listed:
        if rule["rule_no"] not in bad and quality_rule_applies(rule):
            out.setdefault(fingerprint(rule), []).append(rule)
    return out


def store_findings(df: DataFrame, rules: Rules, row_id: str, path: str) -> list[str]:
    """Evaluate the rules that are not stored below `path` and store what they flag; returns their fingerprints.

    `row_id` names a column of whole numbers from 0, one per row and the same every time. One pass, combined into bitmaps before the shuffle.
    """
    spark = df.sparkSession
    fresh = {f: own[0] for f, own in usable_rules(df, rules).items() if f not in known_fingerprints(spark, path)}
    if not fresh:
        return []
    types = {f.name: f.dataType for f in df.schema}
    number = column(row_id).cast("long")
    flagged = [F.when(quality_condition(r, column(r["attribute"]), types[r["attribute"]]), F.lit(f)) for f, r in fresh.items()]
    found = df.select(number.alias("row"), F.explode(F.array_compact(F.array(*flagged))).alias("fingerprint"))
    bitmaps = found.groupBy("fingerprint", F.expr("bitmap_bucket_number(row)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(row))").alias("bits")
    )
    known = spark.createDataFrame([(f, _KNOWN, None) for f in fresh], STORED)
    bitmaps.unionByName(known).write.mode("append").partitionBy("fingerprint").parquet(path)
    return list(fresh)


def stored_findings(spark: SparkSession, path: str, fingerprints: Sequence[str]) -> DataFrame:
    """(fingerprint, bucket, bits) of some rules; other folders are not read."""
    stored = spark.read.schema(STORED).parquet(path)
    return stored.where(F.col("fingerprint").isin(list(fingerprints)) & (F.col("bucket") != _KNOWN))


def _has(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substr(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0


def recheck(df: DataFrame, rules: Rules, row_id: str, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rule_no, attribute, message) of every flagged cell, as `violations` has them, for a table that was checked before.

    Rules that are new below `path` are evaluated and stored first, in an action; nothing else is evaluated.
    """
    store_findings(df, rules, row_id, path)
    by_print = usable_rules(df, rules)
    spark = df.sparkSession
    listed = [(f, r["rule_no"], r["attribute"], r["message"]) for f, own in by_print.items() for r in own]
    named = spark.createDataFrame(listed, "fingerprint string, rule_no int, attribute string, message string")
    kept = df.select(*[column(k) for k in keys], column(row_id).cast("long").alias("_row"))
    placed = kept.withColumns({"_bucket": F.expr("bitmap_bucket_number(_row)"), "_position": F.expr("bitmap_bit_position(_row)")})
    # all bitmaps of 32,768 rows together: a row meets its bucket once, however many rules there are
    bitmaps = stored_findings(spark, path, list(by_print)).groupBy("bucket").agg(F.collect_list(F.struct("fingerprint", "bits")).alias("_maps"))
    met = placed.join(bitmaps, F.col("_bucket") == F.col("bucket"))
    hit = F.transform(F.filter("_maps", lambda m: _has(m["bits"], F.col("_position"))), lambda m: m["fingerprint"])
    found = met.select(*[column(k) for k in keys], F.explode(hit).alias("fingerprint"))
    return found.join(named, "fingerprint").drop("fingerprint")


def counts(df: DataFrame, rules: Rules, row_id: str, path: str) -> DataFrame:
    """(rule_no, attribute, message, violations) from the bitmaps alone, rules without a violation included."""
    store_findings(df, rules, row_id, path)
    by_print = usable_rules(df, rules)
    listed = [(f, r["rule_no"], r["attribute"], r["message"]) for f, own in by_print.items() for r in own]
    named = df.sparkSession.createDataFrame(listed, "fingerprint string, rule_no int, attribute string, message string")
    counted = stored_findings(df.sparkSession, path, list(by_print)).groupBy("fingerprint").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))
    return named.join(counted, "fingerprint", "left").select("rule_no", "attribute", "message", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))


def changed_rules(before: Mapping[str, Sequence[Rule]], after: Mapping[str, Sequence[Rule]]) -> set[str]:
    """Fingerprints in the second of two `usable_rules` that the first lacks: what a changed rule set has to evaluate."""
    return set(after) - set(before)
