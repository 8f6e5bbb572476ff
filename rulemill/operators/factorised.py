"""Queries over the flat rows of nested records, without making them.

The flat rows of a record are the product of its branches, so their number is the product of the branch sizes, and inside a
group the sum of such products. A condition reads one branch only: every branch counts its entries by which of its conditions
hold, and the counts of those combinations that make the whole predicate true are multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulemill.functions.columns import column
from rulemill.operators.nesting import PART, Group, NestingSpec, Structs, Values, flatten
from rulemill.plans.predicates import checked_rules, condition_on, fold_rules
from rulemill.plans.rules import Rule, Rules

#: Conditions of one predicate: the combinations of what holds double with each.
MOST_CONDITIONS = 10
_COUNT, _SUM = "bigint", "decimal(38,6)"

#: Which conditions hold -> how many flat rows, or what they add up to.
Counts = dict[frozenset[int], Column]


@dataclass(frozen=True)
class _Query:
    rules: Sequence[Rule]
    types: dict[str, T.DataType]
    #: flat column to add up; None counts rows
    added: str | None = None

    @property
    def unit(self) -> str:
        return _SUM if self.added else _COUNT

    def reads(self, branch: Values | Structs) -> bool:
        """Whether a condition or the sum needs what is in the entries of a branch."""
        flat = {branch.column} if isinstance(branch, Values) else set(branch.columns)
        return not flat.isdisjoint({self.added, *(r["parameter"] for r in self.rules)})

    def own(self, fields: dict[str, Column]) -> tuple[list[tuple[int, Column]], Column]:
        """The conditions on some flat columns, and what a row with them counts."""
        tests = [
            (i, F.coalesce(condition_on(c, name, r["parameter_type"], r["condition"], r["value"], self.types[name]), F.lit(False)))
            for name, c in fields.items() for i, r in enumerate(self.rules) if r["parameter"] == name
        ]
        number = fields.get(self.added) if self.added else None
        worth = F.lit(1).cast(self.unit) if number is None else F.coalesce(number.try_cast(_SUM), F.lit(0).cast(_SUM))
        return tests, worth

    def held(self, rows: frozenset[int]) -> bool:
        """Whether the predicate is true where just these conditions are."""
        if not self.rules:
            return True
        place = {id(r): i for i, r in enumerate(self.rules)}
        return fold_rules(self.rules, lambda r: place[id(r)] in rows, all, any)


def _subsets(tests: list[tuple[int, Column]]) -> list[frozenset[int]]:
    return [frozenset(i for (i, _), holds in zip(tests, bits) if holds) for bits in product((False, True), repeat=len(tests))]


def _exactly(tests: list[tuple[int, Column]], wanted: frozenset[int]) -> Column:
    return reduce(lambda a, b: a & b, [c if i in wanted else ~c for i, c in tests], F.lit(True))


def _fields(branch: Values | Structs | Group, entry: Column) -> dict[str, Column]:
    """Flat columns of one entry, lists inside it left out."""
    if isinstance(branch, Values):
        return {branch.column: entry}
    listed = branch.fields if isinstance(branch, Structs) else (branch.lead, *branch.scalars)
    return {c: entry.getField(n) for n, c in listed}


def _of_entry(query: _Query, branch, entry: Column, kind: T.DataType) -> Counts:
    """The flat rows of one entry of a branch."""
    tests, worth = query.own(_fields(branch, entry))
    inner: list[Counts] = []
    if isinstance(branch, Group):
        inner = [_of_list(query, b, entry.getField(b.name), kind[b.name].dataType) for b in (*branch.values, *branch.structs, *branch.groups)]
    below = _multiplied(inner, query)
    return {
        own | rest: F.when(_exactly(tests, own), worth * n).otherwise(F.lit(0)).cast(query.unit) for own in _subsets(tests) for rest, n in below.items()
    }


def _of_list(query: _Query, branch, items: Column, kind: T.ArrayType) -> Counts:
    """The flat rows of a list: the sum over its entries; a list without entries is one row of NULLs."""
    empty = F.coalesce(F.size(items), F.lit(0)) <= 0
    entries = F.when(empty, F.array(F.lit(None).cast(kind.elementType))).otherwise(items)
    keys = list(_of_entry(query, branch, F.lit(None).cast(kind.elementType), kind.elementType))
    zero = F.lit(0).cast(query.unit)

    def total(key: frozenset[int]) -> Column:
        return F.aggregate(entries, zero, lambda acc, e: (acc + _of_entry(query, branch, e, kind.elementType)[key]).cast(query.unit))

    if not isinstance(branch, Group) and not query.reads(branch):
        return {frozenset(): F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(1)).cast(query.unit)}
    return {key: total(key) for key in keys}


def _multiplied(parts: list[Counts], query: _Query) -> Counts:
    out: Counts = {frozenset(): F.lit(1).cast(query.unit)}
    for part in parts:
        out = {a | b: (m * n).cast(query.unit) for a, m in out.items() for b, n in part.items()}
    return out


def flat_rows(df: DataFrame, spec: NestingSpec, rules: Rules | None = None, name: str = "n", added: str | None = None) -> DataFrame:
    """The records with the number of their flat rows for which query rules hold, as `query(flatten(df, spec), rules)` has them; with `added`,
    with the sum of that flat column over these rows, as decimal(38,6), NULL and text that is no number counting 0.

    The plan has no explode and no shuffle; its size depends on the rules and the spec. Records in parts are not accepted.
    """
    if PART in df.columns:
        raise ValueError("records in parts have to be put together first")
    query = _query(df, spec, rules, added)
    scalars = {c: column(n) for n, c in spec.scalars} | {spec.key: column(spec.key)}
    tests, worth = query.own(scalars)
    parts = [_of_list(query, b, column(b.name), df.schema[b.name].dataType) for b in (*spec.values, *spec.structs, *spec.groups)]
    wanted = []
    for own in _subsets(tests):
        for rest, n in _multiplied(parts, query).items():
            if query.held(own | rest):
                wanted.append(F.when(_exactly(tests, own), worth * n).otherwise(F.lit(0)).cast(query.unit))
    return df.withColumn(name, reduce(lambda a, b: (a + b).cast(query.unit), wanted) if wanted else F.lit(0).cast(query.unit))


def _query(df: DataFrame, spec: NestingSpec, rules: Rules | None, added: str | None) -> _Query:
    types = {f.name: f.dataType for f in flatten(df, spec).schema}
    listed = checked_rules(rules, types) if rules is not None else []
    if len(listed) > MOST_CONDITIONS:
        raise ValueError(f"a predicate over flat rows has {MOST_CONDITIONS} conditions at most; flatten the records for more")
    if added is not None and added not in types:
        raise ValueError(f"no flat column {added}")
    return _Query(listed, types, added)
