"""Nest, flatten and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill import Group, NestingSpec, Structs, Values, flatten, flatten_branch, flatten_cut, merge_ci, merge_items_ci, nest
from rulemill.operators.factorised import flat_rows
from rulemill.operators.merging import correlated_children, distinct_on
from rulemill.operators.nesting import valid_tuples
from suite.registry import LABELLED, labelled_documents, register, table

BY_CUSTOMER = NestingSpec(
    "o_custkey",
    values=(Values("statuses", "o_orderstatus"), Values("priorities", "o_orderpriority")),
)
HISTORY = NestingSpec(
    "o_custkey",
    scalars=(("last_priority", "o_orderpriority"),),
    structs=(Structs("kinds", (("status", "o_orderstatus"), ("priority", "o_orderpriority")), lead="o_orderstatus"),),
)
TWO_LEVEL = NestingSpec(
    "o_custkey",
    groups=(
        Group(
            "statuses",
            lead=("status", "o_orderstatus"),
            scalars=(("priority", "o_orderpriority"),),
            structs=(Structs("flags", (("flag", "l_returnflag"), ("line", "l_linestatus"))),),
            values=(Values("lines", "l_linenumber"),),
        ),
    ),
)


@register("""
SELECT conv_id, arg_max(role, first_turn) AS role
FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""")
def nest_last_distinct(spark, sf):
    spec = NestingSpec("conv_id", scalars=(("role", "role"),))
    return nest(table(spark, sf, "conversations"), spec, order_by="turn")


@register("""
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses,
       string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
FROM orders GROUP BY o_custkey""")
def nest_sets(spark, sf):
    nested = nest(table(spark, sf, "orders"), BY_CUSTOMER, order_by="o_orderkey")
    return nested.select("o_custkey", *[F.array_join(c, ",").alias(c) for c in ("statuses", "priorities")])


@register("""
WITH firsts AS (SELECT o_custkey, o_orderstatus AS s, o_orderpriority AS p, min(o_orderkey) AS pos FROM orders GROUP BY ALL),
last AS (SELECT o_custkey, arg_max(p, pos) AS last_priority FROM (SELECT o_custkey, p, min(pos) AS pos FROM firsts GROUP BY ALL) GROUP BY o_custkey)
SELECT f.o_custkey, any_value(last_priority) AS last_priority, string_agg(s || ':' || p, ',' ORDER BY s, pos) AS kinds, count(*) AS n
FROM firsts f JOIN last l ON f.o_custkey = l.o_custkey GROUP BY f.o_custkey""")
def nest_structs(spark, sf):
    nested = nest(table(spark, sf, "orders"), HISTORY, order_by="o_orderkey")
    shown = F.transform("kinds", lambda k: F.concat_ws(":", k["status"], k["priority"]))
    return nested.select(
        "o_custkey", "last_priority", F.array_join(shown, ",").alias("kinds"), F.size("kinds").cast("bigint").alias("n")
    )


TWO_LEVEL_SQL = """
WITH r AS (SELECT o.*, l.l_returnflag, l.l_linestatus, l.l_linenumber FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
prio AS (SELECT o_custkey, o_orderstatus, arg_max(o_orderpriority, pos) AS priority
         FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS pos FROM r GROUP BY ALL) GROUP BY ALL),
flags AS (SELECT o_custkey, o_orderstatus, string_agg(l_returnflag || l_linestatus, ',' ORDER BY pos, l_returnflag, l_linestatus) AS flags
          FROM (SELECT o_custkey, o_orderstatus, l_returnflag, l_linestatus, min(o_orderkey) AS pos FROM r GROUP BY ALL) GROUP BY ALL),
lines AS (SELECT o_custkey, o_orderstatus, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS lines
          FROM r GROUP BY ALL)
SELECT p.o_custkey, p.o_orderstatus AS status, p.priority, f.flags, l.lines
FROM prio p JOIN flags f USING (o_custkey, o_orderstatus) JOIN lines l USING (o_custkey, o_orderstatus)"""


def order_lines(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


@register(TWO_LEVEL_SQL)
def nest_two_level(spark, sf):
    nested = nest(order_lines(spark, sf), TWO_LEVEL, order_by="o_orderkey")
    statuses = nested.select("o_custkey", F.inline("statuses"))
    flags = F.transform("flags", lambda f: F.concat(f["flag"], f["line"]))
    return statuses.select(
        "o_custkey", "status", "priority", F.array_join(flags, ",").alias("flags"),
        F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"),
    )


@register("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def nest_split_keys(spark, sf):
    """Customers in three records each; together they hold every child once."""
    nested = nest(table(spark, sf, "orders"), HISTORY, order_by="o_orderkey", parts=3)
    spec = NestingSpec("o_custkey", structs=HISTORY.structs)
    return flatten_branch(nested, spec, "kinds").where(F.col("o_orderstatus").isNotNull())


@register("SELECT DISTINCT event_type, user_id FROM events")
def nest_hot_keys(spark, sf):
    """Five keys share the whole table; every one is written in eight parts."""
    spec = NestingSpec("event_type", structs=(Structs("users", (("user_id", "user_id"),)),))
    nested = nest(table(spark, sf, "events"), spec, order_by="event_id", parts=8)
    return flatten_branch(nested, spec, "users").where(F.col("user_id").isNotNull())


@register("""
SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def nest_hot_key_sizes(spark, sf):
    """Parts of one key are disjoint, so their sizes add up."""
    spec = NestingSpec("event_type", values=(Values("users", "user_id"),))
    nested = nest(table(spark, sf, "events"), spec, order_by="event_id", parts=8)
    return nested.groupBy("event_type").agg(F.sum(F.coalesce(F.size("users"), F.lit(0))).cast("bigint").alias("users"))


@register("""
SELECT s.o_custkey, s.o_orderstatus, p.o_orderpriority
FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) s JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) p
  ON s.o_custkey = p.o_custkey""")
def flatten_product(spark, sf):
    return flatten(nest(table(spark, sf, "orders"), BY_CUSTOMER, order_by="o_orderkey"), BY_CUSTOMER)


@register("""
SELECT s.o_custkey, s.o_orderstatus, p.o_orderkey
FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) s JOIN orders p ON s.o_custkey = p.o_custkey""")
def flatten_split(spark, sf):
    """Records of more than ten combinations are shared by several tasks."""
    spec = NestingSpec("o_custkey", values=(Values("statuses", "o_orderstatus"), Values("keys", "o_orderkey")))
    return flatten(nest(table(spark, sf, "orders"), spec, order_by="o_orderkey"), spec, split_over=10)


@register("""
SELECT s.o_custkey, s.o_orderstatus, p.o_orderpriority
FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) s JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) p
  ON s.o_custkey = p.o_custkey""")
def flatten_cut_records(spark, sf):
    """Records in parts still give every combination, here without the column that numbers the parts."""
    nested = nest(table(spark, sf, "orders"), BY_CUSTOMER, order_by="o_orderkey", parts=2)
    return flatten_cut(nested.drop("_part"), BY_CUSTOMER)


@register("""
SELECT s.o_custkey, s.o_orderstatus, p.o_orderpriority
FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) s JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) p
  ON s.o_custkey = p.o_custkey""")
def flatten_parts_default(spark, sf):
    """Plain `flatten` knows parts."""
    return flatten(nest(table(spark, sf, "orders"), BY_CUSTOMER, order_by="o_orderkey", parts=4), BY_CUSTOMER)


@register("""
SELECT c_custkey AS o_custkey, o_orderstatus, o_orderpriority
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) o
  ON c_custkey = o_custkey""")
def flatten_outer(spark, sf):
    """Customers without an order keep one row."""
    every = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    spec = NestingSpec("o_custkey", structs=HISTORY.structs)
    return flatten(nest(every.join(table(spark, sf, "orders"), "o_custkey", "left"), spec, order_by="o_orderkey"), spec)


@register("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority, l_returnflag, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def flatten_two_level(spark, sf):
    """flatten(nest(x)) is the distinct input when every key has one multi-valued branch."""
    spec = NestingSpec(
        "o_orderkey_text",
        scalars=(("customer", "o_custkey"),),
        groups=(
            Group(
                "statuses",
                lead=("status", "o_orderstatus"),
                scalars=(("priority", "o_orderpriority"),),
                structs=(Structs("flags", (("flag", "l_returnflag"), ("line", "l_linestatus"))),),
            ),
        ),
    )
    rows = order_lines(spark, sf).withColumn("o_orderkey_text", F.col("o_orderkey").cast("string"))
    return flatten(nest(rows, spec, order_by="o_orderkey"), spec).drop("o_orderkey_text").distinct()


def mixed_case_events(spark, sf):
    spelled = (
        F.when(F.col("event_id") % 3 == 0, F.upper("event_type"))
        .when(F.col("event_id") % 3 == 1, F.initcap("event_type"))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf, "events").select("event_id", "user_id", spelled.alias("event_type"))


MIXED = """(SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN upper(event_type)
            WHEN 1 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END AS event_type FROM events)"""


@register(f"""
SELECT user_id, arg_min(event_type, event_id) AS event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event
FROM {MIXED} GROUP BY user_id, lower(event_type)""")
def merge_spellings(spark, sf):
    merged = merge_ci(mixed_case_events(spark, sf), ["user_id"], "event_type", "event_id")
    return merged.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


@register(f"""
WITH named AS (SELECT user_id, lower(event_type) AS k, arg_min(event_type, event_id) AS name, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids
               FROM {MIXED} GROUP BY ALL)
SELECT user_id, name, ids FROM named""")
def merge_into_lists(spark, sf):
    """Rows of one name become one list, under the spelling that came first."""
    merged = merge_ci(mixed_case_events(spark, sf), ["user_id"], "event_type", "event_id")
    spec = NestingSpec(
        "user_id", groups=(Group("names", ("name", "event_type"), structs=(Structs("events", (("id", "event_id"),)),)),)
    )
    named = nest(merged, spec, order_by="event_id").select("user_id", F.inline("names"))
    ids = F.transform("events", lambda e: e["id"].cast("string"))
    return named.select("user_id", "name", F.array_join(ids, ",").alias("ids"))


@register("""
WITH s AS (SELECT l_orderkey, l_suppkey, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
named AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN lower(flag) ELSE flag END AS spelled FROM s)
SELECT l_orderkey, arg_min(spelled, l_suppkey) AS flag, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS suppliers
FROM named GROUP BY l_orderkey, lower(spelled)""")
def merge_in_row(spark, sf):
    """The same on an array of structs within one row."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_returnflag").alias("flag"))
    # Orders have a handful of suppliers, so the arrays stay short.
    spelled = F.when(F.col("l_suppkey") % 2 == 0, F.lower("flag")).otherwise(F.col("flag"))
    spec = NestingSpec("l_orderkey", structs=(Structs("flags", (("pos", "l_suppkey"), ("flag", "spelled"))),))
    nested = nest(lines.withColumn("spelled", spelled), spec, order_by="l_suppkey")
    merged = nested.select("l_orderkey", F.inline(merge_items_ci(F.col("flags"), "flag")))
    sizes = F.transform("items", lambda i: i["pos"].cast("string"))
    return merged.select("l_orderkey", "flag", F.array_join(sizes, ",").alias("suppliers"))


@register("""
SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS line_sum
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_linestatus FROM lineitem) l
  ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL""")
def correlated_lines(spark, sf):
    """Children kept in the row, filtered by a value of their parent."""
    spec = NestingSpec("o_orderkey", scalars=(("o_orderstatus", "o_orderstatus"),),
                       structs=(Structs("lines", (("line", "l_linenumber"), ("status", "l_linestatus"))),))
    nested = nest(order_lines(spark, sf), spec, order_by="o_orderkey")
    own = correlated_children(F.col("o_orderstatus"), F.col("lines"), "status")
    line_sum = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x["line"])
    return nested.select("o_orderkey", "o_orderstatus", F.size(own).cast("bigint").alias("n"), line_sum.alias("line_sum"))


@register("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_subset(spark, sf):
    return distinct_on(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@register(f"SELECT DISTINCT quality, toxic FROM {LABELLED} WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def tuples_without_nulls(spark, sf):
    return valid_tuples(labelled_documents(spark, sf), ["quality", "toxic"])


ORDER_PRODUCT = "(SELECT s.o_custkey, s.o_orderstatus, p.o_orderpriority, k.o_orderkey FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) s JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) p ON s.o_custkey = p.o_custkey JOIN orders k ON k.o_custkey = s.o_custkey)"
WITH_KEYS = NestingSpec("o_custkey", values=(*BY_CUSTOMER.values, Values("keys", "o_orderkey")))


@register(f"SELECT o_custkey, count(*) AS n FROM {ORDER_PRODUCT} GROUP BY o_custkey")
def flat_count(spark, sf):
    """How many flat rows a record has, from the sizes of its branches."""
    nested = nest(table(spark, sf, "orders"), WITH_KEYS, order_by="o_orderkey")
    return flat_rows(nested, WITH_KEYS).select("o_custkey", "n")


@register(f"""
SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM {ORDER_PRODUCT}
WHERE (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND o_orderkey > 500 GROUP BY o_custkey""")
def flat_count_filtered(spark, sf):
    """Rows of the product under conditions on several branches, and the sum of a column over them."""
    rules = [
        ("no", "and", "o_orderkey", "integer", ">", "500"), ("yes", "or", "o_orderstatus", "string", "=", "F"),
        ("no", None, "o_orderpriority", "string", "in", "1-URGENT, 2-HIGH"),
    ]
    nested = nest(table(spark, sf, "orders"), WITH_KEYS, order_by="o_orderkey")
    counted = flat_rows(flat_rows(nested, WITH_KEYS, rules), WITH_KEYS, rules, "total", added="o_orderkey")
    return counted.where("n > 0").select("o_custkey", "n", F.col("total").cast("bigint").alias("total"))


@register("""
SELECT o_custkey, count(*) AS n FROM (
  SELECT f.o_custkey, f.o_orderstatus, f.l_returnflag, l.l_linenumber
  FROM (SELECT DISTINCT o_custkey, o_orderstatus, l_returnflag, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey) f
  JOIN (SELECT DISTINCT o_custkey, o_orderstatus, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey) l
    ON l.o_custkey = f.o_custkey AND l.o_orderstatus = f.o_orderstatus)
WHERE l_returnflag = 'A' AND l_linenumber > 2 GROUP BY o_custkey""")
def flat_count_two_level(spark, sf):
    """Products inside each group of a record, added up over its groups."""
    rules = [("no", "and", "l_returnflag", "string", "=", "A"), ("no", None, "l_linenumber", "integer", ">", "2")]
    nested = nest(order_lines(spark, sf), TWO_LEVEL, order_by="o_orderkey")
    return flat_rows(nested, TWO_LEVEL, rules).where("n > 0").select("o_custkey", "n")
