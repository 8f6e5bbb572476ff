"""Rule-driven data integration, querying and quality checks as Spark DataFrame plans."""

from rulemill.operators.explore import drop_all_null, keyword_search, ordinals, page, page_info, row_ids
from rulemill.operators.integrate import found_nothing, search, unite
from rulemill.operators.mapping import conform, map_columns
from rulemill.operators.merging import merge_ci, merge_items_ci
from rulemill.operators.nesting import Group, NestingSpec, Structs, Values, flatten, flatten_branch, flatten_cut, nest
from rulemill.operators.quality import apply_quality, apply_quality_sets, quality_summary, violations
from rulemill.operators.transform import apply_transforms
from rulemill.plans.pipeline import Source, integrate
from rulemill.plans.predicates import compile_rules, compile_tree, query, query_sql, query_tree
from rulemill.plans.rules import RuleError, as_rules, read_rules, validate_query_rules

__all__ = [
    "Group", "NestingSpec", "RuleError", "Source", "Structs", "Values", "apply_quality", "apply_quality_sets",
    "apply_transforms", "as_rules", "compile_rules", "compile_tree", "conform", "drop_all_null", "flatten",
    "flatten_branch", "flatten_cut", "found_nothing", "integrate", "keyword_search", "map_columns", "merge_ci", "merge_items_ci",
    "nest", "ordinals", "page", "page_info", "quality_summary", "query", "query_sql", "query_tree", "read_rules",
    "row_ids", "search", "unite", "validate_query_rules", "violations",
]
