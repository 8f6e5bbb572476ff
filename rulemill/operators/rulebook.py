"""Many rules at once: which rows satisfy which of thousands of conjunctions.

The rules are a table, and stay one: the plan does not grow with their number. Every rule is filed under the narrowest of its conditions, a
text it requires or an interval. An interval is cut into a few cells whose size, a power of two, follows its own width; a value looks
under its cell of every size that some rule has, so that an equi-join on (cell, size and attribute) finds every interval that may hold
it. All conditions are checked on the pairs that are found, by compiled comparisons: a row of the book has the conditions of a rule side by side,
for each attribute the tightest.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulemill.functions.columns import all_of, any_of, column, let
from rulemill.plans.predicates import checked_rules
from rulemill.plans.rules import RuleError, Rules, query_values

#: One row per condition. A rule holds where all its conditions do: a number between bounds (NULL: none), or a text.
CONDITIONS = "rule string, attribute string, low double, low_in boolean, high double, high_in boolean, text string"
#: Bounds of an attribute that tell how narrow a condition is; they are spread evenly over the bounds of the rules.
_QUANTILES = 64
_SHARES = ",".join(str(i / _QUANTILES) for i in range(_QUANTILES + 1))
#: Cells are 2 ** 50 times smaller than the largest bound at least, so that their numbers are exact; larger bounds than this count as none where rules are filed.
_FINEST, _LARGEST = 50, 1e150
#: Where rows are added up, cells are so many times 2 smaller than those an interval is filed in, and the largest block is so many times 2 larger
#: than they: an interval spans at most 8 of the cells it is filed in, so 2 ** (3 + 2) of these and one.
_FINER, _SIZES = 2, 5


def conditions_of(spark: SparkSession, rule_sets: Mapping[str, Rules], types: Mapping) -> DataFrame:
    """Query-rule tables by name as conditions. Only conjunctions of comparisons, ranges and equal texts can be filed."""
    rows: list[tuple] = []
    for name, rules in rule_sets.items():
        for i, r in enumerate(listed := checked_rules(rules, types)):
            if i < len(listed) - 1 and r["operator"].lower() != "and":
                raise RuleError([(r["rule_no"], r["parameter"], "only conjunctions are filed")])
            rows.append((name, r["parameter"], *_interval(r)))
    return spark.createDataFrame(rows, CONDITIONS)


def _interval(rule) -> tuple:
    condition, values = rule["condition"], query_values(rule["condition"], rule["value"])
    if rule["parameter_type"] == "string" and condition in ("=", "=="):
        return None, None, None, None, values[0]
    bounds = {"=": "ii", "==": "ii", ">": "o.", ">=": "i.", "<": ".o", "<=": ".i", "between": "ii"}.get(condition)
    if rule["parameter_type"] in ("string", "boolean") or bounds is None:
        raise RuleError([(rule["rule_no"], rule["parameter"], f"{condition} is not filed")])
    low, high = float(values[0]), float(values[-1])
    return low if bounds[0] != "." else None, bounds[0] == "i", high if bounds[1] != "." else None, bounds[1] == "i", None


def _bounds(conditions: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for all tasks: for attribute i the least and the greatest bound `_lo<i>` and `_hi<i>`, bounds spread over all (`_spread<i>`), and about how many texts are asked of it (`_texts<i>`)."""
    listed = conditions.select("attribute", "text", F.explode(F.array("low", "high")).alias("bound"))
    listed = listed.withColumn("bound", F.when(F.abs("bound") <= _LARGEST, F.col("bound")))
    out = []
    for i, n in enumerate(names):
        mine = F.when(F.col("attribute") == n, F.col("bound"))
        spread = F.percentile_approx(mine, F.split(F.lit(_SHARES), ",").cast("array<double>"), 64 * _QUANTILES)
        out += [F.coalesce(F.min(mine), F.lit(0.0)).alias(f"_lo{i}"), F.coalesce(F.max(mine), F.lit(0.0)).alias(f"_hi{i}"), F.coalesce(spread, F.array().cast("array<double>")).alias(f"_spread{i}")]
        out.append(F.approx_count_distinct(F.when(F.col("attribute") == n, F.col("text"))).alias(f"_texts{i}"))
    return listed.agg(*out)


def _clipped(i: int, value: Column) -> Column:
    """A number, or one beyond all bounds of attribute i where it lies outside them; the order is kept, and no cell of an interval between bounds reaches beyond them."""
    lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
    far = hi - lo + _magnitude(i) * 2.0**-20
    return F.when(value < lo, lo - far).when(value > hi, hi + far).otherwise(value)


def _magnitude(i: int) -> Column:
    return F.greatest(F.abs(f"_lo{i}"), F.abs(f"_hi{i}"), F.lit(1e-200))


def _cell(value: Column, level: Column) -> Column:
    """The number of the cell of a value among cells of size 2 ** level. It never falls where values rise."""
    return F.rint(value / F.pow(F.lit(2.0), level)).cast("long")


def _kind(i: int, level: Column | None) -> Column:
    """One number for an attribute and a size of cells, or for the texts of the attribute."""
    return F.lit(4096 * i) if level is None else level + 4096 * i + 2048


def _place(node: Column, kind: Column) -> Column:
    return F.struct(node.alias("node"), kind.alias("kind"))


def _way(i: int) -> Column:
    """How a rule can be filed by attribute i, the share of values that it lets pass first, as far as the rules themselves tell; NULL without a condition on it."""
    text, low, high = F.col(f"_text{i}"), F.col(f"_from{i}"), F.col(f"_to{i}")
    way = lambda share, **more: F.struct(share.alias("share"), F.lit(i).alias("attribute"), *[c.alias(n) for n, c in more.items()])
    # the ends are evaluated once, not for every element
    among = lambda ends: F.size(F.filter(f"_spread{i}", lambda b: b.between(ends["low"], ends["high"])))
    within = let(F.struct(low.alias("low"), high.alias("high")), among) / float(_QUANTILES)
    share = F.greatest(within, F.least(F.lit(0.5 / _QUANTILES), (high - low) / (F.col(f"_hi{i}") - F.col(f"_lo{i}") + _magnitude(i))))
    level = F.when(high > low, F.greatest(F.floor(F.log2(high - low)).cast("int") - 2, _finest(i))).otherwise(_finest(i))
    numeric = way(share, level=level, low=low, high=high, text=F.lit(None).cast("string"))
    asked = way(1.0 / F.greatest(f"_texts{i}", F.lit(1)), level=F.lit(None).cast("int"), low=F.lit(None).cast("double"), high=F.lit(None).cast("double"), text=text)
    return F.when(text.isNotNull(), asked).when(F.col(f"_number{i}"), numeric)


def _filed(conditions: DataFrame, names: Sequence[str], bounds: DataFrame) -> DataFrame:
    """One row for each rule that can hold: its conditions side by side, and `_way`, how it is filed."""
    known = F.col("attribute").isin(list(names))
    tightest, impossible = [], []
    for i, n in enumerate(names):
        own = F.col("attribute") == n
        numeric = own & F.col("text").isNull()
        low = F.max(F.when(numeric & F.col("low").isNotNull(), F.struct("low", (~F.coalesce("low_in", F.lit(False))).alias("open"))))
        high = F.min(F.when(numeric & F.col("high").isNotNull(), F.struct("high", F.coalesce("high_in", F.lit(False)).alias("closed"))))
        text = F.when(own, F.col("text"))
        tightest += [
            low["low"].alias(f"_low{i}"), low["open"].alias(f"_open{i}"), high["high"].alias(f"_high{i}"), high["closed"].alias(f"_closed{i}"),
            F.min(text).alias(f"_text{i}"), F.max(text).alias(f"_other{i}"), F.coalesce(F.bool_or(numeric), F.lit(False)).alias(f"_number{i}"),
        ]
        impossible += [F.col(f"_text{i}") != F.col(f"_other{i}"), F.isnan(f"_low{i}"), F.col(f"_low{i}") > F.col(f"_high{i}")]
    book = conditions.where("rule IS NOT NULL").groupBy("rule").agg(F.bool_and(known).alias("_complete"), *tightest).where("_complete")
    book = book.where(~F.coalesce(any_of(F.coalesce(c, F.lit(False)) for c in impossible), F.lit(False))).drop("_complete", *[f"_other{i}" for i in range(len(names))])
    kept, ends = book.columns, []
    for i in range(len(names)):
        # a missing bound, and a NaN above, are no bound
        ends += [_clipped(i, F.coalesce(f"_low{i}", F.lit(float("-inf")))).alias(f"_from{i}"), _clipped(i, F.coalesce(f"_high{i}", F.lit(float("inf")))).alias(f"_to{i}")]
    return book.join(F.broadcast(bounds)).select("*", *ends).select(*kept, F.array_min(F.array(*[_way(i) for i in range(len(names))])).alias("_way"))


def _finest(i: int) -> Column:
    return F.floor(F.log2(_magnitude(i))).cast("int") - _FINEST


def _used(filed: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for all tasks: the sizes of cells (`_levels<i>`) and the values (`_from<i>` to `_to<i>`) under which rules are filed by attribute i, and whether any is by a text of it (`_asked<i>`)."""
    out = []
    for i in range(len(names)):
        own = F.col("_way.attribute") == i
        mine = lambda c, own=own: F.when(own, F.col(f"_way.{c}"))
        out += [F.collect_set(mine("level")).alias(f"_levels{i}"), F.min(mine("low")).alias(f"_from{i}"), F.max(mine("high")).alias(f"_to{i}")]
        out.append((F.count(mine("text")) > 0).alias(f"_asked{i}"))
    return filed.agg(*out)


def matches(df: DataFrame, conditions: DataFrame, keys: Sequence[str], attributes: Iterable[str], totals: Mapping[str, str | None] | None = None) -> DataFrame:
    """(keys, rule) for every row of `df` and every rule whose conditions all hold for it; with `totals` (rule, totals) for every rule that holds for any
    row: the sum of a column over the rows, or their number (None). The pairs are not listed for that, and there are no keys.

    `attributes` are the columns that conditions may name; numbers compare as double, NULL satisfies nothing. A rule without a condition
    does not exist; a rule on another attribute never holds. A few numbers about each attribute travel to all tasks.
    """
    names = list(dict.fromkeys(attributes))
    if totals is not None:
        if keys:
            raise ValueError("totals are those of all rows, whatever their keys")
        return _totals(df, conditions, names, totals)
    bounds = _bounds(conditions, names)
    filed = _filed(conditions, names, bounds)
    one_row = bounds.drop(*[f"_spread{i}" for i in range(len(names))]).join(F.broadcast(_used(filed, names)))
    way = F.col("_way")
    kind = way["attribute"] * 4096 + F.coalesce(way["level"] + 2048, F.lit(0))
    nodes = F.when(way["text"].isNotNull(), F.array(F.xxhash64(way["text"]))).otherwise(F.sequence(_cell(way["low"], way["level"]), _cell(way["high"], way["level"])))
    book = filed.withColumns({"_kind": kind, "_node": F.explode(nodes)}).drop("_way")

    own = [f"_key{j}" for j in range(len(keys))]
    rows = _valued(df, {o: column(k) for k, o in zip(keys, own)}, names, one_row)
    looked = F.flatten(F.array_compact(F.array(*[c for i in range(len(names)) for c in _looked(i)])))
    rows = rows.select(*own, *_values(names), F.inline(looked).alias("_node", "_kind"))
    met = rows.join(book, ["_node", "_kind"]).where(all_of(_holds(i) for i in range(len(names))))
    return met.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], "rule")


def _totals(df: DataFrame, conditions: DataFrame, names: Sequence[str], totals: Mapping[str, str | None]) -> DataFrame:
    """The interval by which a rule is filed is cut into the fewest blocks of cells, each of some size, that lie within it, and the two cells of its
    ends. Rows are added up once for every block and combination of the other attributes before the rules meet them; in the cells of the ends they are
    compared one by one. All other conditions are checked as for pairs.
    """
    bounds = _bounds(conditions, names)
    filed = _filed(conditions, names, bounds)
    limits = bounds.drop(*[f"_spread{i}" for i in range(len(names))])
    finer = lambda i: lambda level: F.greatest(level - _FINER, _finest(i))
    used = limits.join(F.broadcast(_used(filed, names)))
    ends = {f"_ends{i}": F.array_distinct(F.transform(f"_levels{i}", finer(i))) for i in range(len(names))}
    sizes = {f"_sizes{i}": F.array_distinct(F.flatten(F.transform(f"_ends{i}", lambda level: F.sequence(level, level + _SIZES)))) for i in range(len(names))}
    one_row = used.withColumns(ends).withColumns(sizes)

    way = F.col("_way")
    entry = lambda node, kind, inner: F.struct(node.alias("_node"), kind.alias("_kind"), inner.alias("_inner"))
    none = F.lit(None).cast("int")
    asked = F.array(entry(F.xxhash64(way["text"]), way["attribute"] * 8192, none))
    least = F.col("_least")
    kind = way["attribute"] * 8192 + least + 2048

    def blocks(j: Column) -> Column:
        """The blocks of 2 ** j cells that a cut into the fewest has: one at the left, one at the right, or neither."""
        left, right = F.ceil((F.col("_first") + 1) / F.pow(F.lit(2.0), j)), F.floor(F.col("_last") / F.pow(F.lit(2.0), j))
        inside = lambda which, node: F.when((left < right) & (which % 2 != 0), entry(node, kind + 4096 + j, way["attribute"]))
        return F.array(inside(left, left), inside(right, right - 1))

    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_SIZES)), blocks))
    interval = F.concat(F.array_distinct(F.array(entry(F.col("_first"), kind, none), entry(F.col("_last"), kind, none))), F.array_compact(cut))
    book = filed.join(F.broadcast(limits))
    book = book.withColumn("_least", F.coalesce(*[F.when(way["attribute"] == i, finer(i)(way["level"])) for i in range(len(names))]))
    book = book.withColumns({"_first": _floor(way["low"], least), "_last": _floor(way["high"], least)})
    shown = [c for c in filed.columns if c != "_way"]
    book = book.select(*shown, F.inline(F.when(way["text"].isNotNull(), asked).otherwise(interval)))
    book = book.withColumns({f"{end}{i}": F.when(~F.col("_inner").eqNullSafe(i), F.col(f"{end}{i}")) for end in ("_low", "_high") for i in range(len(names))})

    summed = {f"_sum{j}": F.lit(1).cast("long") if c is None else column(c) for j, c in enumerate(totals.values())}
    rows = _valued(df, summed, names, one_row)
    places = []
    for i in range(len(names)):
        number, text = F.col(f"_n{i}"), F.col(f"_t{i}")
        at = lambda sizes, inner, i=i: lambda v: F.when(
            v.between(F.col(f"_from{i}"), F.col(f"_to{i}")),
            F.transform(f"_{sizes}{i}", lambda level: entry(_floor(v, level), level + 8192 * i + 2048 + (4096 if inner else 0), F.lit(i) if inner else none)),
        )
        for sizes, inner in (("ends", False), ("sizes", True)):
            places.append(F.when(number.isNotNull() & (F.size(f"_levels{i}") > 0), let(_clipped(i, number), at(sizes, inner))))
        places.append(F.when(text.isNotNull() & F.col(f"_asked{i}"), F.array(entry(F.xxhash64(text), F.lit(8192 * i), none))))
    rows = rows.select(*summed, *_values(names), F.inline(F.flatten(F.array_compact(F.array(*places)))))
    # within a block the attribute that it is one of holds, whatever its value
    values = [F.when(~F.col("_inner").eqNullSafe(i), F.col(f"_n{i}")).alias(f"_n{i}") for i in range(len(names))]
    texts = [f"_t{i}" for i in range(len(names))]
    rows = rows.select(*summed, "_node", "_kind", *values, *texts)
    added = rows.groupBy("_node", "_kind", *_values(names)).agg(*[F.sum(c).alias(c) for c in summed])
    inner = F.col("_inner")
    met = added.join(book, ["_node", "_kind"]).where(all_of(_holds(i, inner.eqNullSafe(i)) for i in range(len(names))))
    return met.groupBy("rule").agg(*[F.sum(c).alias(name) for c, name in zip(summed, totals)])


def _floor(value: Column, level: Column) -> Column:
    """The number of the cell of a value among cells of size 2 ** level that begin at 0. Two cells of one size make one of the next."""
    parts = value / F.pow(F.lit(2.0), level)
    return F.when((value < 0) & (parts > -1), F.lit(-1).cast("long")).otherwise(F.floor(parts))


def _values(names: Sequence[str]) -> list[str]:
    return [f"_n{i}" for i in range(len(names))] + [f"_t{i}" for i in range(len(names))]


def _valued(df: DataFrame, kept: Mapping[str, Column], names: Sequence[str], one_row: DataFrame) -> DataFrame:
    """The columns that are kept, and for attribute i its number `_n<i>` and, where a rule asks for a text of it, its text `_t<i>`; beside them the one row for all."""
    numbers = [column(n).try_cast("double") for n in names]
    cells = [c for i, n in enumerate(names) for c in (F.when(~F.isnan(numbers[i]), numbers[i]).alias(f"_n{i}"), column(n).cast("string").alias(f"_t{i}"))]
    rows = df.select(*[c.alias(name) for name, c in kept.items()], *cells).join(F.broadcast(one_row))
    return rows.withColumns({f"_t{i}": F.when(F.col(f"_texts{i}") > 0, F.col(f"_t{i}")) for i in range(len(names))})


def _holds(i: int, known: Column | None = None) -> Column:
    """The conditions on attribute i hold; those on its number need not be checked where that is known."""
    v, low, high = F.col(f"_n{i}"), F.col(f"_low{i}"), F.col(f"_high{i}")
    above = low.isNull() | (v > low) | (~F.col(f"_open{i}") & (v == low))
    under = high.isNull() | (v < high) | (F.col(f"_closed{i}") & (v == high))
    number = ~F.col(f"_number{i}") | (v.isNotNull() & above & under)
    return (number if known is None else known | number) & (F.col(f"_text{i}").isNull() | (F.col(f"_t{i}") == F.col(f"_text{i}")))


def _looked(i: int) -> list[Column]:
    """Where a row looks for rules that are filed by attribute i."""
    under = lambda v: F.when(v.between(F.col(f"_from{i}"), F.col(f"_to{i}")), F.transform(f"_levels{i}", lambda level: _place(_cell(v, level), _kind(i, level))))
    numeric = F.when(F.col(f"_n{i}").isNotNull() & (F.size(f"_levels{i}") > 0), let(_clipped(i, F.col(f"_n{i}")), under))
    return [numeric, F.when(F.col(f"_t{i}").isNotNull() & F.col(f"_asked{i}"), F.array(_place(F.xxhash64(f"_t{i}"), _kind(i, None))))]
