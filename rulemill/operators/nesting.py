"""Flat rows to nested records and back, driven by a NestingSpec.

`nest` reads its input once and finds the distinct values of every branch, at any depth, in one aggregate that is combined
before the shuffle; one exchange by key then brings together what is already distinct, and groups are collected in place. One record is one row; where keys have more distinct children than a row
should hold, `parts` deals the children of every key out to that many records.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulemill.functions.columns import all_of, any_of, column, null_if_empty
from rulemill.plans.rules import RuleError

#: The column that numbers the parts of a record, where `nest` makes parts. `flatten` knows parts by it.
PART = "_part"


@dataclass(frozen=True)
class Values:
    """array<scalar> `name`: distinct non-null values of `column`, ascending."""

    name: str
    column: str


@dataclass(frozen=True)
class Structs:
    """array<struct> `name` with fields ((output name, flat column), ...).

    With `lead`, tuples are ordered by that flat column and dropped where it is NULL; within equal leads, and
    without a lead, by first appearance. All-NULL tuples are always dropped.
    """

    name: str
    fields: tuple[tuple[str, str], ...]
    lead: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(c for _, c in self.fields)

    @property
    def lead_field(self) -> str:
        """Output name of the lead column."""
        return next(n for n, c in self.fields if c == self.lead)


@dataclass(frozen=True)
class Group:
    """array<struct> `name`, one struct per value of `lead`, ascending, holding further scalars and lists."""

    name: str
    lead: tuple[str, str]
    scalars: tuple[tuple[str, str], ...] = ()
    values: tuple[Values, ...] = ()
    structs: tuple[Structs, ...] = ()
    groups: tuple[Group, ...] = ()


@dataclass(frozen=True)
class NestingSpec:
    """Shape of a nested record: key, scalars (last distinct value by first appearance), lists and groups."""

    key: str
    scalars: tuple[tuple[str, str], ...] = ()
    values: tuple[Values, ...] = ()
    structs: tuple[Structs, ...] = ()
    groups: tuple[Group, ...] = ()
    order: tuple[str, ...] = ()

    def flat_columns(self) -> list[str]:
        """Flat columns in the order `flatten` returns them."""
        listed = [self.key, *_node_columns(self)]
        return list(self.order) if self.order else list(dict.fromkeys(listed))


def _node_columns(node) -> list[str]:
    listed = [c for _, c in node.scalars] + [v.column for v in node.values]
    listed += [c for s in node.structs for c in s.columns]
    for g in node.groups:
        listed += [g.lead[1], *_node_columns(g)]
    return listed


def _narrow(node, present: set[str]):
    """The part of a node whose flat columns exist."""
    structs = []
    for s in node.structs:
        fields = tuple(f for f in s.fields if f[1] in present)
        if fields and (s.lead is None or s.lead in present):
            structs.append(replace(s, fields=fields))
    return replace(
        node,
        scalars=tuple(f for f in node.scalars if f[1] in present),
        values=tuple(v for v in node.values if v.column in present),
        structs=tuple(structs),
        groups=tuple(_narrow(g, present) for g in node.groups if g.lead[1] in present),
    )


def nest(
    df: DataFrame,
    spec: NestingSpec,
    order_by: str | None = None,
    parts: int = 1,
    within: Sequence[str] = (),
) -> DataFrame:
    """One nested record per non-null key; with `within`, per key and value of those (non-null) columns.

    `order_by` names a column, unique per row, that says which row comes first; without it the order in which the
    rows are read counts. Columns the table lacks are left out of the record; a missing key is an error.

    A record is one row, so all distinct children of a key must fit in one. With `parts` above 1 the children of every key are
    dealt by a hash to up to that many records, numbered in a column `_part` that is then always there; the scalars stand in
    part 0, which every key has. The number of parts depends on nothing but the parameter, and `flatten` puts parts together.
    """
    if parts < 1:
        raise ValueError("a record has at least one part")
    if spec.key not in df.columns:
        raise RuleError([(0, spec.key, "the key column does not exist")])
    spec = _narrow(spec, set(df.columns))
    position = column(order_by) if order_by else F.monotonically_increasing_id()
    keys = [*within, spec.key]
    used = list(dict.fromkeys([*keys, *_node_columns(spec)]))
    rows = df.select(*[column(c) for c in used], position.alias("_pos"))
    rows = rows.where(all_of(column(k).isNotNull() for k in keys))
    nested = _nest_rows(rows, keys, spec, parts)
    part = [column(PART)] if parts > 1 else []
    named = [column(f"_key{i}").alias(k) for i, k in enumerate(keys)]
    return nested.select(*named, *part, *[column(n) for n in _outputs(spec)])


def _outputs(node) -> list[str]:
    scalars = [n for n, _ in node.scalars]
    return scalars + [b.name for b in (*node.values, *node.structs, *node.groups)]


@dataclass(frozen=True)
class _Place:
    """A node of the record: the record itself (number 0) or a group, with the numbers and lead columns of the groups from the outermost
    to itself."""

    number: int
    node: NestingSpec | Group
    path: tuple[int, ...] = ()
    leads: tuple[str, ...] = ()

    @property
    def depth(self) -> int:
        return len(self.path)

    def output(self, i: int) -> str:
        return f"_out{self.number}_{i}"


@dataclass(frozen=True)
class _Branch:
    """What a copy of a row can stand for: a scalar, a value or a tuple of a node, or only that the node is there."""

    number: int
    place: _Place
    item: tuple[str, str] | Values | Structs | None
    cell: str | None = None

    @property
    def always(self) -> bool:
        """It counts whether or not it has a value, and stands in the first part."""
        return self.item is None or isinstance(self.item, tuple)


def _places(node: NestingSpec | Group, above: _Place | None, numbers: Iterator[int]) -> list[_Place]:
    number = next(numbers)
    here = _Place(number, node) if above is None else _Place(number, node, (*above.path, number), (*above.leads, node.lead[1]))
    return [here, *(p for g in node.groups for p in _places(g, here, numbers))]


def _nest_rows(rows: DataFrame, keys: list[str], root: NestingSpec, parts: int) -> DataFrame:
    """(_key0.., _part, outputs of the record): up to `parts` rows per key combination.

    Every row is copied once for each branch that it fills, of the record and of its groups at any depth. A copy carries its branch number, the
    leads of the groups around the branch, and the value of that branch only: in a cell shared by all single-column branches of one type, or
    in a struct of its own. Equal copies are combined before a shuffle that deals them by all of this, so a hot key is spread by its
    values; a second one deals what is left by key and part, and there groups are collected from the inside outwards, each level in place.
    """
    key_names = [f"_key{i}" for i in range(len(keys))]
    places = _places(root, None, count())
    depth = max(p.depth for p in places)
    kind = {c: rows.schema[c].dataType for c in rows.columns}
    branches, cells, structs = [], {}, 0
    for place in places:
        node = place.node
        for item in [*(node.scalars or [None]), *node.values, *node.structs]:
            cell = None
            if isinstance(item, Structs):
                cell, structs = f"_struct{structs}", structs + 1
            elif item is not None:
                cell = cells.setdefault(kind[item.column if isinstance(item, Values) else item[1]], f"_cell{len(cells)}")
            branches.append(_Branch(len(branches), place, item, cell))
    value_names = [*cells.values(), *[f"_struct{i}" for i in range(structs)]]
    of = lambda wanted: F.col("_branch").isin([b.number for b in branches if wanted(b)])

    # the leads around a branch, by depth and type
    leads: dict[tuple[int, T.DataType], str] = {}
    for place in places[1:]:
        leads.setdefault((place.depth, kind[place.node.lead[1]]), f"_lead{len(leads)}")
    lead_of = lambda place: leads[place.depth, kind[place.node.lead[1]]]
    # every branch's value, prepared once for a row: a copy only picks its own
    ready = {name: _by_branch(branches, lambda b, n=name: next((column(p.node.lead[1]) for p in places if p.number in b.place.path and lead_of(p) == n), None)) for name in leads.values()}
    ready |= {name: _by_branch(branches, lambda b, n=name: column(b.item.column if isinstance(b.item, Values) else b.item[1]) if b.cell == n else None) for name in cells.values()}
    tuples = {b.cell: b for b in branches if isinstance(b.item, Structs)}
    ready |= {name: F.struct(*[column(c).alias(n) for n, c in b.item.fields]) for name, b in tuples.items()}
    numbers = F.array_compact(F.array(*[F.when(_fills(b), F.lit(b.number)) for b in branches]))
    prepared = rows.select(*[column(c).alias(n) for c, n in zip(keys, key_names)], numbers.alias("_branches"), *[v.alias(n) for n, v in ready.items()], "_pos")
    picked = [
        (F.when(F.col("_branch") == tuples[n].number, F.col(n)) if n in tuples else F.get(n, F.col("_branch"))).alias(n) for n in ready
    ]
    copies = prepared.withColumn("_branch", F.explode("_branches")).select(*key_names, "_branch", *picked, "_pos")
    what = [*key_names, "_branch", *leads.values(), *value_names]
    if all(p.node.scalars == () and p.node.structs == () for p in places):
        items = copies.select(*what).distinct().withColumn("_pos", F.lit(0))  # sorted values need no position
    else:
        items = copies.groupBy(*what).agg(F.min("_pos").alias("_pos"))

    # the part of a child among those of its node, and of each group around it among those of the node around that
    part_names = [PART, *[f"_part{d}" for d in range(1, depth + 1)]] if parts > 1 else []
    own = F.when(of(lambda b: b.always), 0).otherwise(F.xxhash64("_branch", *value_names))
    for d in range(len(part_names) - 1, -1, -1):
        outward = F.xxhash64(*[name for (at, _), name in leads.items() if at == d + 1], part_names[d + 1]) if d < depth else F.lit(0)
        spread = F.when(of(lambda b, d=d: b.place.depth == d), own).when(of(lambda b, d=d: b.place.depth > d), outward).otherwise(0)
        items = items.withColumn(part_names[d], F.pmod(spread, F.lit(parts)).cast("int"))
    for d in range(1, depth + 1):
        group = _chosen([(of(lambda b, p=p: p.number in b.place.path), F.lit(p.number)) for p in places if p.depth == d])
        items = items.withColumn(f"_group{d}", group)

    def by(d: int) -> list[str]:
        return [*key_names, *part_names[: d + 1], *[f"_group{i}" for i in range(1, d + 1)], *[name for (at, _), name in leads.items() if at <= d]]

    nested = items.repartition(*by(0)) if depth else items
    collected = [_collected(b).alias(b.place.output(i)) for p in places for i, b in _outputs_of(p, branches)]
    nested = nested.groupBy(*by(depth)).agg(*collected) if collected else nested.select(*by(depth)).distinct()
    lists = {b.place.output(i): _without_order(b.place.output(i), b) for p in places for i, b in _outputs_of(p, branches) if not isinstance(b.item, tuple)}
    nested = nested.withColumns(lists) if lists else nested
    for d in range(depth - 1, -1, -1):
        done = [p for p in places if p.depth <= d]
        kept = [F.first(p.output(i), ignorenulls=True).alias(p.output(i)) for p in done for i, _ in _outputs_of(p, branches)]
        entries = []
        for p in places:
            if p.depth == d + 1:
                entry = F.struct(F.col(lead_of(p)).alias("_lead"), *part_names[d + 1 : d + 2], _entry(p, places, branches, lead_of(p)).alias("_fields"))
                entries.append(F.array_sort(F.collect_list(F.when(F.col(f"_group{d + 1}") == p.number, entry))).alias(f"_list{p.number}"))
        nested = nested.groupBy(*by(d)).agg(*kept, *entries)
        nested = nested.withColumns({f"_list{p.number}": null_if_empty(F.transform(f"_list{p.number}", lambda x: x["_fields"])) for p in places if p.depth == d + 1})
    return nested.select(*key_names, *part_names[:1], *_fields_of(places[0], places, branches))


def _by_branch(branches: list[_Branch], value: Callable[[_Branch], Column | None]) -> Column:
    """An array with a value at the number of each branch, NULL where it has none."""
    found = [value(b) for b in branches]
    return F.array(*[F.lit(None) if v is None else v for v in found])


def _fills(b: _Branch) -> Column:
    """Whether a row has something for a branch."""
    present = [column(lead).isNotNull() for lead in b.place.leads]
    if isinstance(b.item, Values):
        present.append(column(b.item.column).isNotNull())
    elif isinstance(b.item, Structs):
        present.append(any_of(column(c).isNotNull() for c in ([b.item.lead] if b.item.lead else b.item.columns)))
    return all_of(present)


def _chosen(choices: list[tuple[Column, Column]]) -> Column:
    chosen = F.when(*choices[0])
    for condition, value in choices[1:]:
        chosen = chosen.when(condition, value)
    return chosen


def _outputs_of(place: _Place, branches: list[_Branch]) -> list[tuple[int, _Branch]]:
    return list(enumerate(b for b in branches if b.place.number == place.number and b.item is not None))


def _collected(b: _Branch) -> Column:
    mine = F.col("_branch") == b.number
    if isinstance(b.item, tuple):
        return F.max_by(F.when(mine, F.col(b.cell)), F.when(mine, F.col("_pos")))
    if isinstance(b.item, Values):
        return F.array_sort(F.collect_list(F.when(mine, F.col(b.cell))))
    lead = [F.col(b.cell).getField(b.item.lead_field).alias("_lead")] if b.item.lead else []
    return F.array_sort(F.collect_list(F.when(mine, F.struct(*lead, F.col("_pos").alias("_pos"), F.col(b.cell).alias("_fields")))))


def _without_order(name: str, b: _Branch) -> Column:
    found = column(name)
    return null_if_empty(F.transform(found, lambda x: x["_fields"]) if isinstance(b.item, Structs) else found)


def _fields_of(place: _Place, places: list[_Place], branches: list[_Branch]) -> list[Column]:
    """The outputs of a node under their names: scalars, values, structs, groups."""
    own = [column(place.output(i)).alias(b.item[0] if isinstance(b.item, tuple) else b.item.name) for i, b in _outputs_of(place, branches)]
    inner = [p for p in places if p.depth == place.depth + 1 and p.path[:-1] == place.path]
    return own + [column(f"_list{p.number}").alias(p.node.name) for p in inner]


def _entry(place: _Place, places: list[_Place], branches: list[_Branch], lead: str) -> Column:
    return F.struct(column(lead).alias(place.node.lead[0]), *_fields_of(place, places, branches))


def flatten(df: DataFrame, spec: NestingSpec, split_over: int | None = None) -> DataFrame:
    """Nested records to wide rows: one row per combination of the children of a record.

    A record without children in a branch keeps one row with NULLs there. The number of rows per record is the
    product of its branch sizes; use `flatten_branch` for the sum instead. With `split_over`, records that yield more
    rows than that are worked on by several tasks, at the price of a shuffle of the nested records. Records that `nest` dealt
    into parts, which a column `_part` tells, are put together first: the rows are those of undivided records.
    """
    repeated = [c for c, n in Counter([spec.key, *_node_columns(spec)]).items() if n > 1]
    if repeated:
        raise RuleError([(0, c, "a flat column can come from one branch only") for c in repeated])
    if PART in df.columns:
        return flatten_cut(df, spec)
    hidden = _hidden(df, spec)
    if split_over is not None:
        hidden = _spread(hidden, spec, split_over)
    flat = _flatten_node(hidden, spec, [spec.key])
    return flat.select(*[column(c) for c in spec.flat_columns()])


def _spread(hidden: DataFrame, spec: NestingSpec, split_over: int) -> DataFrame:
    """Copies of large records, each with a slice of their longest list; every combination is in one copy."""
    lists = [f"_list_{b.name}" for b in _branches(spec)]
    sizes = [F.greatest(F.coalesce(F.size(column(c)), F.lit(0)), F.lit(1)) for c in lists]
    yielded = reduce(lambda x, y: x * y, [_yield(column(c), b) for c, b in zip(lists, _branches(spec))])
    longest = F.array_max(F.array(*sizes))
    # No more slices than the longest list has elements, so that none is empty.
    slices = F.greatest(F.least(F.ceil(yielded / F.lit(float(split_over))), longest.cast("bigint")), F.lit(1)).cast("int")
    sliced = hidden.withColumns({"_slices": slices, "_longest": F.array_position(F.array(*sizes), longest) - 1})
    sliced = sliced.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))

    def part_of(c: str, i: int) -> Column:
        own = F.filter(column(c), lambda _, n: n % F.col("_slices") == F.col("_slice"))
        return F.when((F.col("_slices") > 1) & (F.col("_longest") == i), own).otherwise(column(c))

    spread = sliced.withColumns({c: part_of(c, i) for i, c in enumerate(lists)})
    return spread.repartition(column(spec.key), F.col("_slice")).drop("_slices", "_longest", "_slice")


def _yield(items: Column, branch) -> Column:
    """How many rows a list expands to, as a double."""
    own = F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(1)).cast("double")
    inner = _branches(branch) if isinstance(branch, Group) else []
    if not inner:
        return own
    below = F.aggregate(
        items,
        F.lit(0.0),
        lambda total, x: total + reduce(lambda a, b: a * b, [_yield(x.getField(b.name), b) for b in inner]),
    )
    return F.greatest(F.coalesce(below, F.lit(1.0)), F.lit(1.0))


def flatten_cut(df: DataFrame, spec: NestingSpec) -> DataFrame:
    """`flatten` for records in parts, whatever their columns say: records of one key belong together.

    The branches of a key are joined across its parts, so every combination is there, whichever parts hold its
    children. Costs one join per branch; AQE splits hot keys.
    """
    flat = _join_parts(_hidden(df, spec), [spec.key], spec)
    return flat.select(*[column(c) for c in spec.flat_columns()])


def _join_parts(df: DataFrame, keys: list[str], node) -> DataFrame:
    names = [column(k) for k in keys]
    scalars = [c for _, c in node.scalars if c not in keys]
    # Only the first part has the scalars, so the highest value is the value.
    flat = df.groupBy(*names).agg(*[F.max(column(c)).alias(c) for c in scalars]) if scalars else df.select(*names).distinct()
    for b in _branches(node):
        source = column(f"_list_{b.name}")
        if isinstance(b, Values):
            rows = df.select(*names, F.explode(source).alias(b.column))
        else:
            element = df.schema[f"_list_{b.name}"].dataType.elementType.names
            flat_name = dict(b.fields) if isinstance(b, Structs) else _inner_names(b)
            rows = df.select(*names, F.inline(source).alias(*[flat_name[n] for n in element]))
        if isinstance(b, Group):
            rows = _join_parts(rows, [*keys, b.lead[1]], b)
        flat = flat.join(rows, keys, "left")
    return flat


def flatten_branch(df: DataFrame, spec: NestingSpec, name: str) -> DataFrame:
    """Key and the rows of one branch only, empty lists giving one row of NULLs."""
    kept = [tuple(b for b in branch if b.name == name) for branch in (spec.values, spec.structs, spec.groups)]
    narrowed = NestingSpec(spec.key, (), *kept)
    if not any(kept):
        raise ValueError(f"no branch {name}")
    part = [column(PART)] if PART in df.columns else []
    return flatten(df.select(column(spec.key), *part, column(name)), narrowed)


def _branches(node):
    return [*node.values, *node.structs, *node.groups]


def _inner_names(g: Group) -> dict[str, str]:
    """Field of a group's struct -> the column it becomes."""
    return {g.lead[0]: g.lead[1], **dict(g.scalars), **{b.name: f"_list_{b.name}" for b in _branches(g)}}


def _hidden(df: DataFrame, spec: NestingSpec) -> DataFrame:
    """Lists under private names, because a list and a flat column may share one."""
    return df.select(
        column(spec.key),
        *[column(n).alias(c) for n, c in spec.scalars if c != spec.key],
        *[column(b.name).alias(f"_list_{b.name}") for b in _branches(spec)],
    )


def _flatten_node(df: DataFrame, node, done: list[str]) -> DataFrame:
    done = done + [c for _, c in node.scalars if c not in done]
    waiting = [f"_list_{b.name}" for b in _branches(node)]
    outer = [c for c in df.columns if c not in done and c not in waiting]

    for b in _branches(node):
        waiting.remove(f"_list_{b.name}")
        source = column(f"_list_{b.name}")
        kept = [column(c) for c in [*done, *outer, *waiting]]
        if isinstance(b, Values):
            df = df.select(*kept, F.explode_outer(source).alias(b.column))
            done = done + [b.column]
            continue
        element = df.schema[f"_list_{b.name}"].dataType.elementType.names
        if isinstance(b, Structs):
            names = dict(b.fields)
            df = df.select(*kept, F.inline_outer(source).alias(*[names[n] for n in element]))
            done = done + [names[n] for n in element]
            continue
        inner = _inner_names(b)
        df = df.select(*kept, F.inline_outer(source).alias(*[inner[n] for n in element]))
        df = _flatten_node(df, b, [*done, b.lead[1]])
        done = [c for c in df.columns if c not in outer and c not in waiting]
    return df


def key_order(df: DataFrame, key: str) -> DataFrame:
    """Records in ascending key order, the order of an exported document."""
    return df.orderBy(column(key))


def valid_tuples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct tuples that are not NULL in every column."""
    tuples = df.select(*[column(c) for c in columns]).distinct()
    return tuples.where(~all_of(column(c).isNull() for c in columns))
