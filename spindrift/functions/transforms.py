"""Transform types of column edges: their order of significance and their rule on Catalyst's node classes."""

from __future__ import annotations

#: Types and their significance; a tie keeps the first.
PRIORITY = {"window": 8, "aggregation": 7, "conditional": 6, "arithmetic": 5, "cast": 4, "function": 3, "rename": 2, "complex": 1, "literal": 1, "join_derived": 1, "passthrough": 0, "unknown": 0}
STATUSES = ("resolved", "ambiguous", "partial", "unresolved")
LITERAL_MODEL = "__literal__"
TRIVIAL = ("passthrough", "rename")

ARITHMETIC = {"Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/", "Remainder": "%", "IntegralDivide": "DIV", "BitwiseAnd": "&", "BitwiseOr": "|"}
#: Aggregate names beyond those that end in _agg or begin with approx_, percentile, regr_ or covar_.
AGGREGATES = frozenset(
    "any any_value avg bit_and bit_or bit_xor bool_and bool_or collect_list collect_set corr count count_if count_min_sketch countif every first first_value grouping grouping_id "
    "histogram_numeric kurtosis last last_value logical_and logical_or max max_by mean median min min_by mode skewness some std stddev stddev_pop stddev_samp sum sumif try_avg try_sum "
    "var_pop var_samp variance".split()
)
CONDITIONAL_FUNCTIONS = frozenset(("if", "iff", "iif"))
FUNCTION_NODES = frozenset("UnresolvedFunction Extract Year Month CurrentDate CurrentTimestamp Overlay StringTrim StringTrimLeft StringTrimRight TimestampAdd TimestampDiff Lower Upper CreateNamedStruct UnresolvedGenerator".split())


def is_aggregate(name: str) -> bool:
    """Whether a function name is an aggregate's."""
    name = name.lower()
    return name in AGGREGATES or name.endswith("_agg") or name.startswith(("approx_", "percentile", "regr_", "covar_"))


def most_significant(types: list[str]) -> str:
    """The type of highest significance, unknown for none."""
    return max(types, key=lambda t: PRIORITY.get(t, 0), default="unknown")
