"""Spark's parsed plans as small Python trees."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from spindrift.functions.dialect import to_spark
from spindrift.functions.transforms import ARITHMETIC


class SqlParseError(ValueError):
    """SQL that neither Spark's parser nor the rewriting takes."""


@dataclass
class Node:
    """One node of a plan or an expression: class name, fields, children."""

    kind: str
    fields: dict
    children: list[Node] = field(default_factory=list)

    def trees(self, name: str) -> list[Node]:
        """The expression trees or plans held in a field."""
        value = self.fields.get(name)
        if not isinstance(value, list) or not value:
            return []
        if isinstance(value[0], list):
            return [tree(v) for v in value]
        return [tree(value)] if "class" in value[0] else []

    def parts(self, name: str) -> list[str]:
        """A field that prints a list of names."""
        value = self.fields.get(name)
        if isinstance(value, list):
            return [str(v) for v in value]
        return [p for p in str(value or "[]")[1:-1].split(", ") if p]


def tree(flat: list[dict]) -> Node:
    """A tree from its nodes in pre-order."""
    it = iter(flat)

    def take() -> Node:
        d = next(it)
        return Node(d["class"].rpartition(".")[2].rstrip("$"), d, [take() for _ in range(d["num-children"])])

    return take()


def parse(spark: SparkSession, sql: str, dialect: str | None = None) -> Node:
    """The unresolved logical plan of one query; on the driver only."""
    from py4j.protocol import Py4JError

    try:
        return tree(json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(to_spark(sql, dialect)).toJSON()))
    except Exception as e:
        if isinstance(e, Py4JError) or type(e).__name__ in ("ParseException", "CapturedException") or "PARSE" in str(e):
            raise SqlParseError(str(e).strip().split("\n")[0]) from e
        raise


#: How operators print.
INFIX = ARITHMETIC | {"EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "And": "AND", "Or": "OR", "Like": "LIKE", "RLike": "RLIKE"}


def sql_of(n: Node) -> str:
    """An expression as SQL text."""
    c = [sql_of(x) for x in n.children]
    f = n.fields
    match n.kind:
        case "UnresolvedAttribute":
            return ".".join(n.parts("nameParts"))
        case "Literal":
            return f"'{f['value']}'" if f.get("dataType") in ("string", "date", "timestamp") and f.get("value") is not None else "NULL" if f.get("value") is None else str(f["value"])
        case "Alias" | "UnresolvedAlias" | "SortOrder" | "UnresolvedWindowExpression":
            return c[0] if c else ""
        case "Cast":
            return f"CAST({c[0]} AS {str(f.get('dataType')).upper()})"
        case "UnresolvedFunction":
            name = ".".join(n.parts("nameParts")).upper()
            if name == "COUNT" and c == ["1"]:
                c = ["*"]
            return f"{name}({'DISTINCT ' if f.get('isDistinct') else ''}{', '.join(c)})"
        case "CaseWhen":
            pairs = [f"WHEN {a} THEN {b}" for a, b in zip(c[::2], c[1::2])]
            return f"CASE {' '.join(pairs)}{f' ELSE {c[-1]}' if len(c) % 2 else ''} END"
        case "WindowExpression":
            return f"{c[0]} OVER ({c[1]})"
        case "WindowSpecDefinition":
            part = f.get("partitionSpec") or []
            order = f.get("orderSpec") or []
            return " ".join(x for x in (f"PARTITION BY {', '.join(c[i] for i in part)}" if part else "", f"ORDER BY {', '.join(c[i] for i in order)}" if order else "") if x)
        case "Concat":
            return " || ".join(c)
        case "Not" | "UnaryMinus" | "IsNull" | "IsNotNull":
            return {"Not": f"NOT {c[0]}", "UnaryMinus": f"-{c[0]}", "IsNull": f"{c[0]} IS NULL", "IsNotNull": f"{c[0]} IS NOT NULL"}[n.kind]
        case "In":
            return f"{c[0]} IN ({', '.join(c[1:])})"
        case "UnresolvedExtractValue":
            return f"{c[0]}[{c[1]}]"
        case "ScalarSubquery":
            return "(SELECT ...)"
    if n.kind in INFIX and len(c) == 2:
        return f"{c[0]} {INFIX[n.kind]} {c[1]}"
    return f"{n.kind.upper()}({', '.join(c)})"
