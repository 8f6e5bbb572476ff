"""Nested records out of any XML, driven by mapping rules.

The paths of the rules say which elements and attributes are needed. They become a declared `from_xml` schema, and
the rules become expressions on the parsed struct. A parent step becomes a test, for A/.. are the elements that have an A. Steps to any
child or any depth, `*` and `//`, are looked up in the structure of the data, the tree of tags that one pass finds, and become all paths of
child steps that lead there; elements are numbered in the text so that what these paths find is put into document order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rulemill.functions.arrays import leading
from rulemill.functions.columns import any_of, blank_to_null, let, null_if_empty, null_string
from rulemill.operators.nesting import Group, NestingSpec, Structs, Values
from rulemill.plans.rules import Rule, RuleError, Rules, as_rules
from rulemill.sources.xml import attribute, children, occurs, parse_elements, read_elements, text_of
from rulemill.variants.schema import VARIANT_SPEC

# The rule class that fills each branch of a variant record.
VARIANT_CLASSES = {
    "genes": "gene",
    "hgvs": "hgvs",
    "assembly": "assembly",
    "databanks": "databank",
    "phenotypes": "phenotype",
    "interpretation": "interpretation",
    "bibliography": "bibliography",
}
ENTITY_CLASS = "variation"
VALUE_MARK = "<value>"
ANY, SELF, PARENT = "*", ".", ".."


class UnsupportedPath(ValueError):
    """A path with an axis, a function or a test that is none of the forms below."""


@dataclass(frozen=True)
class Test:
    """[@name], [@name='v'], [name], [name='v'], [n], or that one of some paths leads anywhere."""

    name: str = ""
    of_attribute: bool = False
    equals: str | None = None
    ordinal: int = 0
    paths: tuple[Path, ...] = ()


@dataclass(frozen=True)
class Step:
    """Children with a tag, of any tag, or the element itself; `deep`: at any depth; `or_self`: and the element itself."""

    tag: str
    tests: tuple[Test, ...] = ()
    deep: bool = False
    or_self: bool = False


Path = tuple[Step, ...]

_STEP = re.compile(r"(\*|[^\W\d][\w.\-]*)((?:\[[^\]]*\])*)$")
_TEST = re.compile(r"\[\s*(?:(\d+)|(@?)([\w.\-]+)\s*(?:=\s*(?:'([^']*)'|\"([^\"]*)\"))?)\s*\]")


def steps_of(path: str) -> Path:
    """`./A/B[@k='v']`, `.//A`, `./A/..` or `./*` as steps without parent steps."""
    steps: list[Step] = []
    deep = False
    for part in re.split(r"/(?![^\[]*\])", path):
        if part in ("", SELF):
            deep = deep or (part == "" and bool(path))
            continue
        if part == PARENT:
            if deep or not steps or steps[-1].tag == SELF:
                raise UnsupportedPath(path)
            _to_parents(steps)
        else:
            steps.append(_step(path, part, deep))
        deep = False
    if deep or not steps:
        raise UnsupportedPath(path)
    return tuple(steps)


def _to_parents(steps: list[Step]) -> None:
    """Replace the last step by the elements that have what it finds."""
    last = steps.pop()
    if last.deep:
        steps.append(Step(ANY, (Test(paths=((replace(last, deep=False, or_self=False),),)),), deep=True, or_self=True))
        return
    has = Test(paths=((last,),))
    before = steps.pop() if steps else Step(SELF)
    steps.append(replace(before, tests=(*before.tests, has)))


def _step(path: str, part: str, deep: bool) -> Step:
    found = _STEP.match(part)
    if not found:
        raise UnsupportedPath(path)
    tests, rest = [], found[2]
    while rest:
        t = _TEST.match(rest)
        if not t:
            raise UnsupportedPath(path)
        equals = t[4] if t[4] is not None else t[5]
        tests.append(Test(ordinal=int(t[1])) if t[1] else Test(t[3], t[2] == "@", equals))
        rest = rest[t.end():]
    ordinals = sum(1 for t in tests if t.ordinal)
    if ordinals > 1 or (ordinals and found[1] == ANY):
        raise UnsupportedPath(path)
    return Step(found[1], tuple(tests), deep)


def _steps_of_rule(rule: Rule, path: str) -> Path:
    try:
        return steps_of(path)
    except UnsupportedPath:
        raise RuleError([(rule["rule_no"], rule["elementName"], f"the path {rule['XPath']} is not supported")]) from None


def needs_structure(steps: Path) -> bool:
    """Whether it depends on the data where a path leads."""
    return any(s.deep or s.tag == ANY or any(needs_structure(p) for t in s.tests for p in t.paths) for s in steps)


# --- structure of the data ----------------------------------------------------------------------


@dataclass
class Tree:
    """The tags below an element, wherever they occur in the data."""

    below: dict[str, Tree] = field(default_factory=dict)

    @classmethod
    def of(cls, kind: T.DataType) -> Tree:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return cls({f.name: cls.of(f.dataType) for f in kind if not f.name.startswith("_")} if isinstance(kind, T.StructType) else {})

    def merged(self, other: Tree) -> Tree:
        tags = [*self.below, *(t for t in other.below if t not in self.below)]
        return Tree({t: self.below.get(t, Tree()).merged(other.below.get(t, Tree())) for t in tags})

    def descendants(self, before: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Tree]]:
        for tag, tree in self.below.items():
            yield (*before, tag), tree
            yield from tree.descendants((*before, tag))

    def everywhere(self, tag: str) -> Tree:
        """What stands below a tag, in all places together."""
        out = Tree()
        for tags, tree in self.descendants():
            if tags[-1] == tag:
                out = out.merged(tree)
        return out

    def paths(self, steps: Path) -> list[Path]:
        """The paths of child steps that a path stands for, each once."""
        if not steps:
            return [()]
        step, found = steps[0], []
        if step.tag == SELF:
            places = [((), self)]
        elif step.deep:
            places = [(tags, tree) for tags, tree in self.descendants() if step.tag in (ANY, tags[-1])] + ([((), self)] if step.or_self else [])
        else:
            places = [((tag,), tree) for tag, tree in self.below.items() if step.tag in (ANY, tag)]
        for tags, tree in places:
            tests = tuple(replace(t, paths=tuple(p for path in t.paths for p in tree.paths(path))) if t.paths else t for t in step.tests)
            if any(t.paths and not new.paths for t, new in zip(step.tests, tests)):
                continue  # nothing can pass
            here = (*map(Step, tags[:-1]), Step(tags[-1] if tags else SELF, tests))
            found += [(*here, *rest) for rest in tree.paths(steps[1:])]
        return list(dict.fromkeys(found))


def structure_of(elements: DataFrame, row_tag: str) -> T.StructType:
    """The tags and attributes that occur in (xml, ...) rows, found by one pass; the result is as large as their variety."""
    spark = elements.sparkSession
    strings = getattr(elements.select("xml")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark._jsparkSession.read().option("rowTag", row_tag).option("attributePrefix", "_").option("valueTag", "_VALUE").option("inferSchema", "false")
    return T.StructType.fromJson(json.loads(reader.xml(strings).schema().json()))


#: Attribute that holds an element's place in the document.
ORDER = "document-order"
_PIECES = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^<]*|\A[^<]+"


def numbered(xml: Column) -> Column:
    """The text with the places of its elements as attributes, in one pass over its pieces."""
    pieces = F.regexp_extract_all(xml, F.lit(_PIECES), F.lit(0))
    with_place = lambda piece, i: F.regexp_replace(
        piece, F.lit(r"\A(<[^\s/>]+)"), F.concat(F.lit(f'$1 {ORDER}="'), F.lpad(i.cast("string"), 10, "0"), F.lit('"'))
    )
    return F.array_join(F.transform(pieces, lambda piece, i: F.when(piece.rlike(r"\A<[\p{L}_]"), with_place(piece, i)).otherwise(piece)), "")


# --- declared schema --------------------------------------------------------------------------


@dataclass
class Shape:
    """What the rules need of one element."""

    attributes: set[str] = field(default_factory=set)
    text: bool = False
    parts: dict[str, Shape] = field(default_factory=dict)

    def at(self, steps: Sequence[Step]) -> Shape:
        shape = self
        for step in steps:
            shape = shape if step.tag == SELF else shape.parts.setdefault(step.tag, Shape())
            for test in step.tests:
                for path in test.paths:
                    shape.at(path)
                if test.of_attribute:
                    shape.attributes.add(test.name)
                elif test.name:
                    shape.parts.setdefault(test.name, Shape()).text = True
        return shape

    def struct(self) -> T.StructType:
        fields = [T.StructField("_" + a, T.StringType()) for a in sorted(self.attributes)]
        fields += [T.StructField(n, T.ArrayType(s.struct())) for n, s in sorted(self.parts.items())]
        if self.text or not fields:
            fields.append(T.StructField("_VALUE", T.StringType()))
        return T.StructType(fields)


class RuleSet:
    """XML mapping rules, by class. Nodes of a `correlated` class are always found from the entity element."""

    def __init__(self, rules: Rules, correlated: Sequence[str] = (), row: int = 0, structure: T.StructType | None = None):
        self.correlated, self.row = set(correlated), row
        self.rules = [{k: ("" if v is None else v) for k, v in r.items()} for r in as_rules(rules, "xml_mapping")]
        self.steps = {r["rule_no"]: _steps_of_rule(r, r["XPath"]) for r in self.rules if r["XPath"]}
        self.tree = None if structure is None else Tree.of(structure)

    def is_ordered(self, rule: Rule) -> bool:
        """Whether several paths lead to what a rule finds, so that places in the document order it. What one path finds is in order."""
        return self.follows_data(rule) and any(len(self.paths(rule, from_entity)) > 1 for from_entity in (False, True))

    def follows_data(self, rule: Rule) -> bool:
        return bool(rule["XPath"]) and needs_structure(self.steps[rule["rule_no"]])

    def _below_rows(self) -> list[Rule]:
        row = self.row_rule()
        return [r for r in self.rules if r["rootName"] != row["rootName"] or r["elementName"] != ENTITY_CLASS]

    def needs_structure(self) -> bool:
        return any(map(self.follows_data, self._below_rows()))

    def needs_places(self) -> bool:
        return any(map(self.is_ordered, self._below_rows()))

    def paths(self, rule: Rule, from_entity: bool = False) -> list[Path]:
        """The paths of child steps that a rule stands for."""
        steps = self.steps[rule["rule_no"]]
        if not needs_structure(steps):
            return [steps]
        if self.tree is None:
            raise RuleError([(rule["rule_no"], rule["elementName"], f"the path {rule['XPath']} needs the structure of the data")])
        root = self.tree if from_entity or rule["rootName"] == self.row_tag() else self.tree.everywhere(rule["rootName"])
        return root.paths(steps)

    def keyed_path(self, rule: Rule) -> tuple[Path, str] | None:
        """The one path of a rule without its test [@name='<value>'] at the end, and that name; None if the rule is not of this form."""
        paths = self.paths(rule, from_entity=True) if rule["ConditionValue"] else []
        if len(paths) != 1 or self.is_ordered(rule):
            return None
        steps = paths[0]
        marked = [t for s in steps for t in s.tests if t.equals == VALUE_MARK]
        last = steps[-1]
        if len(marked) != 1 or marked[0] not in last.tests or not marked[0].of_attribute or last.tag == SELF or any(t.ordinal for t in last.tests):
            return None
        return (*steps[:-1], replace(last, tests=tuple(t for t in last.tests if t is not marked[0]))), marked[0].name

    def nodes(self, class_name: str) -> list[Rule]:
        return [r for r in self.rules if r["elementName"] == class_name and r["attrName"] == "" and r["XPath"]]

    def properties(self, class_name: str, attr: str) -> list[Rule]:
        return [r for r in self.rules if r["elementName"] == class_name and r["attrName"] == attr]

    def row_rule(self) -> Rule:
        found = self.nodes(ENTITY_CLASS)
        if not found:
            raise RuleError([(0, ENTITY_CLASS, "no rule says which element holds an entity")])
        return found[self.row]

    def row_alternatives(self) -> int:
        return len(self.nodes(ENTITY_CLASS))

    def row_tag(self) -> str:
        rule = self.row_rule()
        tag = self.steps[rule["rule_no"]][-1].tag
        if tag in (ANY, SELF):
            raise RuleError([(rule["rule_no"], ENTITY_CLASS, f"the path {rule['XPath']} names no row element")])
        return tag

    def row_tests(self) -> tuple[Test, ...]:
        rule = self.row_rule()
        tests = self.steps[rule["rule_no"]][-1].tests
        if any(t.paths for t in tests):
            raise RuleError([(rule["rule_no"], ENTITY_CLASS, f"the path {rule['XPath']} leads to a parent")])
        return tests

    def shape(self) -> Shape:
        """Everything the rules touch below the entity element."""
        entity = Shape()
        row_tag = self.row_tag()
        roots = {row_tag: [entity]}
        for test in self.row_tests():
            entity.at([Step(SELF, (test,))])
        for rule in self.rules:
            rooted = rule["rootName"] == row_tag or rule["elementName"] in self.correlated
            if rule["attrName"] == "" and rule["XPath"] and rooted and rule is not self.row_rule():
                for steps in self.paths(rule, from_entity=True):
                    target = entity.at(steps)
                    roots.setdefault(_last_tag(steps, row_tag), []).append(target)
                    target.attributes |= {ORDER} if self.is_ordered(rule) else set()
        for rule in self.rules:
            is_node_rule = rule["attrName"] == "" and rule["XPath"] and not rule["rootAttr"]
            if rule["FixedValue"] or (is_node_rule and rule["elementName"] in self._node_classes()):
                continue
            for shape in roots.get(rule["rootName"], []):
                for steps in self.paths(rule) if rule["XPath"] else [()]:
                    target = shape.at(steps)
                    target.attributes |= {ORDER} if self.is_ordered(rule) else set()
                    if rule["rootAttr"]:
                        target.attributes.add(rule["rootAttr"])
                    else:
                        target.text = True
        return entity

    def _node_classes(self) -> set[str]:
        return {ENTITY_CLASS, *VARIANT_CLASSES.values()}


# --- expressions ------------------------------------------------------------------------------


def _passes(element: Column, test: Test, value: Column | None) -> Column:
    if test.paths:
        return any_of(F.size(F.coalesce(_walk(F.array(element), path, value), F.array())) > 0 for path in test.paths)
    wanted = None
    if test.equals is not None:
        wanted = value if test.equals == VALUE_MARK else F.lit(test.equals)
    if test.of_attribute:
        found = attribute(element, test.name)
        return found.isNotNull() if wanted is None else found == wanted
    named = element.getField(test.name)
    if wanted is None:
        return F.size(F.coalesce(named, F.array())) > 0
    return F.exists(named, lambda c: text_of(c) == wanted)


def _passing(test: Test, value: Column | None):
    return lambda e: F.coalesce(_passes(e, test, value), F.lit(False))


def _below(step: Step, value: Column | None):
    """The matching children of one parent. A position counts all children of that name, whatever other tests say."""

    def matching(parent: Column) -> Column:
        found = F.array(parent) if step.tag == SELF else parent.getField(step.tag)
        for test in sorted(step.tests, key=lambda t: not t.ordinal):
            found = F.slice(found, test.ordinal, 1) if test.ordinal else F.filter(found, _passing(test, value))
        return found

    return matching


def _walk(elements: Column, steps: Sequence[Step], value: Column | None = None) -> Column:
    """Elements along a path, in document order."""
    for step in steps:
        if step.tag == SELF and not step.tests:
            continue
        if step.tests:
            lists = F.transform(elements, _below(step, value))
            elements = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
        else:
            elements = children(elements, step.tag)
    return elements


class _Compiler:
    def __init__(self, rules: RuleSet, classes: dict[str, str]):
        self.rules, self.classes = rules, classes
        self.row_tag = rules.row_tag()

    def property(self, class_name: str, attr: str, node: Column, tag: str) -> Column:
        """The first alternative that is present."""
        found = []
        for rule in self.rules.properties(class_name, attr):
            if rule["FixedValue"]:
                found.append(F.lit(rule["FixedValue"]))
                break
            if rule["rootName"] != tag:
                continue
            paths = self.rules.paths(rule) if rule["XPath"] else [()]
            firsts = [F.get(_walk(F.array(node), steps), F.lit(0)) if rule["XPath"] else node for steps in paths]
            values = [attribute(target, rule["rootAttr"]) if rule["rootAttr"] else text_of(target) for target in firsts]
            if self.rules.is_ordered(rule):
                placed = [F.when(attribute(t, ORDER).isNotNull(), F.struct(attribute(t, ORDER).alias("place"), v.alias("value"))) for t, v in zip(firsts, values)]
                values = [F.array_min(F.array(*placed)).getField("value")] if placed else []
            found += [blank_to_null(v) for v in values]
        return F.coalesce(*found) if found else null_string()

    def found(self, rule: Rule, branch, element: Column, value: Column | None) -> Column:
        """The entries of the nodes that a rule finds below the entity, in document order; NULL or empty if there are none.

        What belongs to the entries by a value of theirs is sorted by that value once, outside of the loop over them.
        """
        sorted_lists = self.sorted_children(branch, element) if isinstance(branch, Group) else []
        if not sorted_lists:
            return self.listed(rule, branch, element, value, {})
        names = [f"rule{n}" for n, _ in sorted_lists]
        together = F.struct(*[c.alias(name) for name, (_, c) in zip(names, sorted_lists)])
        return let(together, lambda t: self.listed(rule, branch, element, value, {n: t.getField(name) for name, (n, _) in zip(names, sorted_lists)}))

    def sorted_children(self, group: Group, element: Column) -> list[tuple[int, Column]]:
        """(rule number, all its nodes as (key, place, entry) in the order of the keys) for the rules that ask for an attribute equal to a value of
        the parent."""
        out = []
        for branch in (*group.values, *group.structs, *group.groups):
            for rule in self.rules.nodes(self.classes[branch.name]):
                keyed = self.rules.keyed_path(rule)
                if keyed is not None:
                    steps, attr = keyed
                    entry = self.entry_of(branch, _last_tag(steps, self.row_tag), element)
                    nodes = F.transform(_walk(F.array(element), steps), _keyed(attr, entry))
                    out.append((rule["rule_no"], F.array_sort(F.filter(nodes, lambda n: n.getField("key").isNotNull()))))
        return out

    def listed(self, rule: Rule, branch, element: Column, value: Column | None, sorted_lists: dict[int, Column]) -> Column:
        paths = self.rules.paths(rule, from_entity=True)
        if paths and not self.rules.is_ordered(rule):
            entry = self.entry_of(branch, _last_tag(paths[0], self.row_tag), element, sorted_lists)
            return F.transform(_walk(F.array(element), paths[0], value), entry)
        none = F.array().cast(_branch_type(branch))
        if not paths:
            return none
        placed = []
        for steps in paths:
            entry = self.entry_of(branch, _last_tag(steps, self.row_tag), element, sorted_lists)
            nodes = F.transform(_walk(F.array(element), steps, value), _placed(entry))
            placed.append(F.coalesce(nodes, F.array().cast(T.ArrayType(_placed_type(branch)))))
        every = F.concat(*placed)
        if len({tuple(s.tag for s in steps if s.tag != SELF) for steps in paths}) < len(paths):
            every = F.array_distinct(every)  # paths that differ in their tests may find the same node
        return F.transform(F.array_sort(every), lambda x: x.getField("entry"))

    def entries(self, branch, element: Column) -> Column:
        """The list of one branch: the first rule that finds nodes."""
        class_name, found = self.classes[branch.name], []
        for rule in self.rules.nodes(class_name):
            if rule["rootName"] != self.row_tag:
                continue
            value = self.property(rule["ConditionValue"], "", element, self.row_tag) if rule["ConditionValue"] else None
            found.append(null_if_empty(self.found(rule, branch, element, value)))
        return F.coalesce(*found) if found else F.lit(None).cast(_branch_type(branch))

    def entry_of(self, branch, tag: str, element: Column, sorted_lists: dict[int, Column] | None = None):
        return lambda node: self.entry(branch, node, tag, element, sorted_lists or {})

    def entry(self, branch, node: Column, tag: str, element: Column, sorted_lists: dict[int, Column]) -> Column:
        class_name = self.classes[branch.name]
        if isinstance(branch, Values):
            return self.property(class_name, class_name, node, tag)
        names = [n for n, _ in branch.fields] if isinstance(branch, Structs) else _scalar_names(branch)
        fields = [self.property(class_name, n, node, tag).alias(n) for n in names]
        if isinstance(branch, Group):
            inner = (*branch.values, *branch.structs, *branch.groups)
            fields += [self.correlated(b, node, tag, element, sorted_lists).alias(b.name) for b in inner]
        return F.struct(*fields)

    def correlated(self, branch, parent: Column, parent_tag: str, element: Column, sorted_lists: dict[int, Column]) -> Column:
        """Nodes anywhere in the entity that belong to this parent, from all rules of the class."""
        parts = []
        for rule in self.rules.nodes(self.classes[branch.name]):
            value = self.property(rule["ConditionValue"], "", parent, parent_tag) if rule["ConditionValue"] else None
            of_rule = sorted_lists.get(rule["rule_no"])
            nodes = self.found(rule, branch, element, value) if of_rule is None else let(value, _equal_to(of_rule))
            parts.append(F.coalesce(nodes, F.array().cast(_branch_type(branch))))
        return null_if_empty(F.concat(*parts)) if parts else F.lit(None).cast(_branch_type(branch))


def _last_tag(steps: Path, row_tag: str) -> str:
    """The tag of the elements a path leads to, from the row element."""
    return next((s.tag for s in reversed(steps) if s.tag != SELF), row_tag)


def _keyed(attr: str, entry):
    return lambda node, place: F.struct(attribute(node, attr).alias("key"), place.alias("place"), entry(node).alias("entry"))


def _equal_to(sorted_nodes: Column):
    """The entries of nodes sorted by their key that have a given one."""

    def entries(value: Column) -> Column:
        first, behind = leading(sorted_nodes, lambda n: n.getField("key") < value), leading(sorted_nodes, lambda n: n.getField("key") <= value)
        return F.when(value.isNotNull(), F.transform(let(first, lambda f: F.slice(sorted_nodes, f + 1, behind - f)), lambda n: n.getField("entry")))

    return entries


def _placed(entry):
    return lambda node: F.struct(attribute(node, ORDER).alias("place"), entry(node).alias("entry"))


def _placed_type(branch) -> T.StructType:
    return T.StructType([T.StructField("place", T.StringType()), T.StructField("entry", _branch_type(branch).elementType)])


def _scalar_names(group: Group) -> list[str]:
    return [group.lead[0], *[n for n, _ in group.scalars]]


def _branch_type(branch) -> T.ArrayType:
    if isinstance(branch, Values):
        return T.ArrayType(T.StringType())
    names = [n for n, _ in branch.fields] if isinstance(branch, Structs) else _scalar_names(branch)
    fields = [T.StructField(n, T.StringType()) for n in names]
    if isinstance(branch, Group):
        fields += [T.StructField(b.name, _branch_type(b)) for b in (*branch.values, *branch.structs, *branch.groups)]
    return T.ArrayType(T.StructType(fields))


def record_type(spec: NestingSpec) -> T.StructType:
    scalars = [spec.key, *[n for n, _ in spec.scalars]]
    fields = [T.StructField(n, T.StringType()) for n in scalars]
    fields += [T.StructField(b.name, _branch_type(b)) for b in (*spec.values, *spec.structs, *spec.groups)]
    return T.StructType(fields)


def extract_entities(
    elements: DataFrame, rules: Rules, spec: NestingSpec = VARIANT_SPEC, classes: dict[str, str] | None = None, row: int = 0,
    structure: T.StructType | None = None,
) -> DataFrame:
    """Nested records from (xml, ...) rows by mapping rules; a list without nodes is NULL. `row` says which rule for entities counts.

    Where paths have `*`, `//` or `..`, a pass over the rows finds their structure, unless it is given as `structure_of` has it.
    """
    classes = classes or VARIANT_CLASSES
    correlated = [classes[b.name] for g in spec.groups for b in (*g.values, *g.structs, *g.groups)]
    rule_set = RuleSet(rules, correlated, row, structure)
    if rule_set.needs_structure():
        if structure is None:
            rule_set = RuleSet(rules, correlated, row, structure_of(elements, rule_set.row_tag()))
        if rule_set.needs_places():
            elements = elements.withColumn("xml", numbered(F.col("xml")))
    shape = rule_set.shape()
    compiler = _Compiler(rule_set, classes)
    element, tag = F.col("element"), compiler.row_tag
    parsed = parse_elements(elements, shape.struct())
    for test in rule_set.row_tests():
        parsed = parsed.where(_passes(element, test, None))
    scalars = [spec.key, *[n for n, _ in spec.scalars]]
    branches = (*spec.values, *spec.structs, *spec.groups)
    return parsed.select(
        *[compiler.property(ENTITY_CLASS, n, element, tag).alias(n) for n in scalars],
        *[compiler.entries(b, element).alias(b.name) for b in branches],
    )


def read_by_rules(
    spark: SparkSession, paths: str | Sequence[str], rules: Rules, row_tag: str | None = None,
    spec: NestingSpec = VARIANT_SPEC, encoding: str = "UTF-8", nested_rows: bool = False,
) -> DataFrame:
    """Nested records of XML files by mapping rules. Of several rules for entities, the first that finds any counts. `nested_rows`: the
    row element may contain itself; what is inside one is part of it."""
    listed = [tuple(r.values())[1:] for r in as_rules(rules, "xml_mapping")]
    last = max(0, RuleSet(listed).row_alternatives() - 1)
    for row in range(last + 1):
        tag = row_tag or RuleSet(listed, row=row).row_tag()
        there = occurs(spark, paths, tag, encoding)
        if not there and row < last:
            continue
        elements = read_elements(spark, paths, tag, encoding, nested_rows)
        records = extract_entities(elements if there else elements.where(F.lit(False)), listed, spec, row=row)
        # stops at the first record
        if row == last or not records.isEmpty():
            return records
