"""From a query's parsed plan to column edges.

Every query block becomes a relation: its output columns in order, each with the base columns that it comes from and
what was done to them. Blocks are worked out from the inside, a CTE once, so scopes are exact and shared CTEs cost
nothing twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from spindrift.functions.transforms import ARITHMETIC, CONDITIONAL_FUNCTIONS, FUNCTION_NODES, LITERAL_MODEL, TRIVIAL, is_aggregate
from spindrift.plans.planwalk import Node, SqlParseError, parse, sql_of, tree


@dataclass(frozen=True)
class Hop:
    """What happened to a base column on its way."""

    type: str
    sql: str
    chain: tuple[tuple[str, str, str], ...] = ()


Origins = dict[tuple[str, str], Hop]
#: Functions without parentheses, and parts of dates as arguments: no columns unless a source has one of that name.
BARE = frozenset("CURRENT_DATE CURRENT_TIMESTAMP CURRENT_TIME CURRENT_USER SESSION_USER LOCALTIME LOCALTIMESTAMP SYSDATE YEAR QUARTER MONTH WEEK ISOWEEK DAY DAYOFWEEK DAYOFYEAR HOUR MINUTE SECOND MILLISECOND MICROSECOND".split())


@dataclass
class Relation:
    """Output columns of a query block or a table; open are tables without schema behind a star."""

    columns: dict[str, tuple[str, Origins]] = field(default_factory=dict)
    open: list[str] = field(default_factory=list)

    def put(self, name: str, origins: Origins) -> None:
        self.columns.setdefault(name.lower(), (name, origins))

    def find(self, name: str) -> Origins | None:
        """Origins of a column; of an unlisted one each open table may be the source."""
        if (hit := self.columns.get(name.lower())) is not None:
            return hit[1]
        return {(t, name): Hop("passthrough", name) for t in self.open} or None


@dataclass
class Source:
    names: frozenset[str]
    relation: Relation


@dataclass
class Analysis:
    """Result for one model."""

    edges: list[dict] = field(default_factory=list)
    columns_attempted: int = 0
    columns_traced: int = 0
    failed_columns: list[str] = field(default_factory=list)
    ambiguous_columns: list[str] = field(default_factory=list)
    unresolved_columns: list[str] = field(default_factory=list)
    output_columns: list[str] = field(default_factory=list)
    error: str | None = None


def classify(n: Node, name: str | None = None) -> str:
    """Transform type of an expression's top node; name is the output's."""
    if n.kind in ("Alias", "UnresolvedAlias"):
        return classify(n.children[0], n.fields.get("name", name))
    if n.kind == "UnresolvedAttribute":
        return "passthrough" if name is None or name.lower() == n.parts("nameParts")[-1].lower() else "rename"
    if n.kind == "Cast":
        return "cast"
    if n.kind in ARITHMETIC:
        return "arithmetic"
    if n.kind in ("WindowExpression", "UnresolvedWindowExpression"):
        return "window"
    if n.kind == "UnresolvedFunction":
        function = n.parts("nameParts")[-1].lower()
        if is_aggregate(function):
            return "aggregation"
        return "conditional" if function in CONDITIONAL_FUNCTIONS else "function"
    if n.kind in ("CaseWhen", "If"):
        return "conditional"
    if n.kind in FUNCTION_NODES:
        return "function"
    return "complex" if any(attributes(n)) or subqueries(n) or existence(n) else "literal"


def attributes(n: Node, key: bool = False) -> tuple[list[Node], list[Node]]:
    """Column references of an expression: those that give values, and those of window keys."""
    if n.kind == "UnresolvedAttribute":
        return ([], [n]) if key else ([n], [])
    values, keys = [], []
    for c in parts_of(n):
        v, k = attributes(c, key or n.kind == "WindowSpecDefinition")
        values += v
        keys += k
    return values, keys


def subqueries(n: Node) -> list[Node]:
    """Plans of subqueries in an expression: scalar ones, and lists behind IN."""
    own = n.trees("plan") if n.kind in ("ScalarSubquery", "ListQuery", "LateralSubquery") else []
    return own + [p for held in parts_of(n) for p in subqueries(held)]


def existence(n: Node) -> list[Node]:
    """Plans under EXISTS in an expression."""
    own = n.trees("plan") if n.kind == "Exists" else []
    return own + [p for held in parts_of(n) for p in existence(held)]


def parts_of(n: Node) -> list[Node]:
    """Children, and what an IN with a subquery holds beside them."""
    return [*n.children, *(n.trees("values") + n.trees("query") if n.kind == "InSubquery" and not n.children else [])]


class Analyzer:
    """Walks one parsed plan against known schemas and table names."""

    def __init__(self, schema: dict[str, dict[str, str]], lookup: dict[str, str]) -> None:
        self.schema = schema
        self.lookup = lookup
        self.tables: dict[str, None] = {}
        self.ambiguous: list[str] = []

    def canonical(self, parts: list[str]) -> str:
        """The canonical name of a table: three, two, one part, else as written."""
        for k in range(min(3, len(parts)), 0, -1):
            if (hit := self.lookup.get(".".join(parts[-k:]).lower())) is not None:
                return hit
        return parts[-1] if len(parts) == 1 else ".".join(parts)

    def table(self, parts: list[str]) -> tuple[str, Relation]:
        name = self.canonical(parts)
        self.tables[name] = None
        known = self.schema.get(name) or self.schema.get(name.lower()) or {}
        r = Relation(open=[] if known else [name])
        for c in known:
            if "." not in c:
                r.put(c, {(name, c): Hop("passthrough", c)})
        return name, r

    # relations

    def query(self, n: Node, ctes: dict[str, Relation]) -> Relation:
        """The relation of any plan node."""
        match n.kind:
            case "UnresolvedWith":
                inner = dict(ctes)
                for x in n.fields["cteRelations"]:
                    name, body = (x["_1"], x["_2"]) if isinstance(x, dict) else x[:2]
                    if n.fields.get("allowRecursion"):
                        inner[name.lower()] = Relation()
                    plan = tree(body)
                    inner[name.lower()] = self.query(plan.children[0] if plan.kind == "SubqueryAlias" else plan, inner)
                return self.query(n.children[0], inner)
            case "Project" | "Aggregate":
                return self.select(n, ctes)
            case "Union" | "Intersect" | "Except":
                return self.set_operation([self.query(c, ctes) for c in n.children])
            case "UnresolvedSubqueryColumnAliases":
                return self.renamed(self.query(n.children[0], ctes), n.parts("outputColumnNames"))
            case "Pivot":
                return self.pivot(n, ctes)
            case "UnresolvedRelation" | "SubqueryAlias" | "Join" | "LateralJoin" | "Generate" | "Filter" if n.kind != "Filter" or not n.children:
                return self.every(self.sources(n, ctes))
            case "LocalRelation" | "UnresolvedInlineTable" | "OneRowRelation" | "Range":
                r = Relation()
                names = [x.fields["name"] for x in n.trees("output")] if n.kind == "LocalRelation" else n.parts("names")
                for name in names:
                    r.put(name, {(LITERAL_MODEL, name): Hop("literal", name)})
                return r
        if len(n.children) == 1:  # filters, sorts, limits, distinct, hints, windows: columns pass
            return self.query(n.children[0], ctes)
        return self.every(self.sources(n, ctes))

    def renamed(self, r: Relation, names: list[str]) -> Relation:
        out = Relation(open=[])
        for name, (_, origins) in zip(names, r.columns.values()):
            out.put(name, origins)
        return out

    def every(self, sources: list[Source]) -> Relation:
        out = Relation()
        for s in sources:
            for name, origins in s.relation.columns.values():
                out.put(name, origins)
            out.open += s.relation.open
        return out

    def set_operation(self, parts: list[Relation]) -> Relation:
        """By position where all widths are known and equal, else by name; names are the first branch's."""
        first = parts[0]
        out = Relation(open=[t for p in parts for t in p.open])
        straight = not out.open and len({len(p.columns) for p in parts}) == 1
        listed = [list(p.columns.values()) for p in parts]
        for i, (name, _) in enumerate(first.columns.values()):
            merged: Origins = {}
            for p, columns in zip(parts, listed):
                for key, hop in ((columns[i][1] if straight else p.find(name)) or {}).items():
                    merged.setdefault(key, hop)
            out.put(name, merged)
        for p in parts[1:] if not straight else []:
            for name, origins in p.columns.values():
                out.put(name, origins)
        return out

    def sources(self, n: Node, ctes: dict[str, Relation]) -> list[Source]:
        """What stands in FROM below a select."""
        if n.kind == "UnresolvedRelation":
            parts = n.parts("multipartIdentifier")
            if len(parts) == 1 and (r := ctes.get(parts[0].lower())) is not None:
                return [Source(frozenset((parts[0].lower(),)), r)]
            name, r = self.table(parts)
            forms = {".".join(parts[-k:]).lower() for k in range(1, len(parts) + 1)} | {name.lower()}
            return [Source(frozenset(forms), r)]
        if n.kind == "LateralJoin":
            found = self.sources(n.children[0], ctes)
            return found + [s for q in n.trees("right") for p in q.trees("plan") for s in self.lateral(p, found, ctes)]
        if n.kind in ("SubqueryAlias", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction") and self.function(n):
            return self.lateral(n, [], ctes)
        if n.kind == "SubqueryAlias":
            alias = n.fields["identifier"]["name"].lower()
            inner = n.children[0]
            r = self.every(self.sources(inner, ctes)) if inner.kind == "UnresolvedRelation" else self.query(inner, ctes)
            return [Source(frozenset((alias,)), r)]
        if n.kind == "Join":
            kind = n.fields.get("joinType")
            found = [s for c in n.children for s in self.sources(c, ctes)]
            if isinstance(kind, dict) and re.search(r"Left(Semi|Anti)", str(kind.get("object") or kind.get("tpe") or kind.get("product-class"))):
                return self.sources(n.children[0], ctes)  # the other side only filters
            shared = Node("", kind).parts("usingColumns") if isinstance(kind, dict) and "usingColumns" in kind else []
            if shared:
                r = Relation()
                for c in shared:
                    r.put(c, {k: h for s in found for k, h in (s.relation.find(c) or {}).items()})
                found.insert(0, Source(frozenset(), r))
            return found
        if n.kind == "Generate":
            found = self.sources(n.children[0], ctes)
            r = Relation()
            for g in n.trees("generator"):
                origins = self.expression(g, found, Relation(), "function")
                for c in n.trees("generatorOutput"):
                    r.put(c.parts("nameParts")[-1] if c.kind == "UnresolvedAttribute" else str(c.fields.get("name")), origins)
            alias = n.fields.get("qualifier")
            return [*found, Source(frozenset((str(alias).lower(),) if alias else ()), r)]
        if n.kind in ("Filter", "Sample", "UnresolvedHint", "UnresolvedHaving", "UnresolvedTableValuedFunction") and n.children:
            return self.sources(n.children[0], ctes)
        if n.kind in ("Pivot", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Project", "Aggregate", "Union", "Intersect", "Except", "LocalRelation", "UnresolvedInlineTable"):
            return [Source(frozenset(), self.query(n, ctes))]
        return [s for c in n.children for s in self.sources(c, ctes)]

    @staticmethod
    def function(n: Node) -> Node | None:
        """The table function under aliases, if that is what a node stands for."""
        while n.kind in ("SubqueryAlias", "UnresolvedTVFAliases") and n.children:
            n = n.children[0]
        return n if n.kind == "UnresolvedTableValuedFunction" else None

    def lateral(self, n: Node, before: list[Source], ctes: dict[str, Relation]) -> list[Source]:
        """The right side of a lateral join: a table function of columns before it, or a subquery."""
        call = self.function(n)
        if call is None:
            return self.sources(n, ctes)
        names: list[str] = []
        alias, at = None, n
        while at is not call:
            alias = at.fields["identifier"]["name"].lower() if at.kind == "SubqueryAlias" else alias
            names = at.parts("outputNames") or names
            at = at.children[0]
        r = Relation()
        for x in call.trees("functionArgs"):
            origins = self.expression(x, before, Relation(), "function")
            for plan in subqueries(x):
                origins = origins | {k: replace(h, type="function") for _, o in self.query(plan, ctes).columns.values() for k, h in o.items()}
            for name in names or ["col"]:
                r.put(name, {k: h for k, h in origins.items() if k[0] != LITERAL_MODEL} or origins)
        return [Source(frozenset((alias,) if alias else ()), r)]

    # one SELECT

    def select(self, n: Node, ctes: dict[str, Relation]) -> Relation:
        found = [s for c in n.children for s in self.sources(c, ctes)]
        out = Relation()
        for e in n.trees("projectList") or n.trees("aggregateExpressions"):
            if e.kind in ("UnresolvedStar", "UnresolvedStarExceptOrReplace"):
                self.star(e, found, out)
                continue
            named = e
            if e.kind == "Alias":
                name = e.fields["name"]
            elif e.kind == "UnresolvedAttribute":
                name = e.parts("nameParts")[-1]
            else:
                named = e.children[0] if e.kind == "UnresolvedAlias" else e
                name = sql_of(named)
            origins = self.expression(e, found, out, classify(e))
            for plan in existence(e):
                for key, hop in self.conditions(plan, found, ctes, classify(e)).items():
                    origins.setdefault(key, hop)
            for plan in subqueries(e):
                for _, more in self.query(plan, ctes).columns.values():
                    for key, hop in more.items():
                        origins.setdefault(key, replace(hop, type=classify(e)))
            out.put(name, origins)
        return out

    def conditions(self, plan: Node, outer: list[Source], ctes: dict[str, Relation], kind: str) -> Origins:
        """Base columns that decide whether a subquery has rows: those of its conditions, looked up inside, then outside."""
        found = [s for c in (plan.children or [plan]) for s in self.sources(c, ctes)]
        out: Origins = {}

        def walk(n: Node) -> None:
            for c in n.trees("condition"):
                for a in attributes(c)[0]:
                    for key in self.column(a, found, Relation()) or self.column(a, outer, Relation()):
                        out.setdefault(key, Hop(kind, "EXISTS(SELECT ...)", ((key[1], "EXISTS(SELECT ...)", kind),)))
            for c in n.children:
                walk(c)

        walk(plan)
        return out

    def pivot(self, n: Node, ctes: dict[str, Relation]) -> Relation:
        """Columns of a PIVOT: those that group, then one for each value and aggregate, from what the aggregate reads."""
        found = [s for c in n.children for s in self.sources(c, ctes)]
        aggregates = n.trees("aggregates")
        used = {a.parts("nameParts")[-1].lower() for x in [*aggregates, *n.trees("pivotColumn")] for a in attributes(x)[0]}
        out = Relation()
        for name, origins in self.every(found).columns.values():
            if name.lower() not in used:
                out.put(name, origins)
        out.open = self.every(found).open
        for v in n.trees("pivotValues"):
            value = v.fields["name"] if v.kind == "Alias" else str(v.fields.get("value", sql_of(v)))
            for x in aggregates:
                name = f"{value}_{x.fields['name'] if x.kind == 'Alias' else sql_of(x)}" if len(aggregates) > 1 else value
                out.put(name, self.expression(x, found, Relation(), classify(x)))
        return out

    def star(self, e: Node, found: list[Source], out: Relation) -> None:
        target = [p.lower() for p in e.parts("target")] if e.fields.get("target") not in (None, "None") else []
        target = [t.removeprefix("some(").removeprefix("list(") for t in target]
        excepts = {str(x).strip("[]").rpartition(", ")[2].lower() for x in e.fields.get("excepts") or []}
        chosen = [s for s in found if not target or ".".join(target).rstrip(")") in s.names]
        listed = self.every(chosen)
        for name, origins in listed.columns.values():
            if name.lower() not in excepts:
                out.put(name, origins)
        out.open += listed.open

    def column(self, a: Node, found: list[Source], before: Relation) -> Origins:
        """Origins of one column reference; empty if unknown or ambiguous."""
        parts = a.parts("nameParts")
        for k in range(len(parts) - 1, 0, -1):
            qualifier = ".".join(parts[:k]).lower()
            for s in found:
                if qualifier in s.names:
                    return s.relation.find(parts[k]) or {}
        name = parts[0]
        if len(parts) == 1 and name.upper() in BARE and not any(name.lower() in s.relation.columns for s in found):
            return {(LITERAL_MODEL, name): Hop("literal", name)}
        listed = [s for s in found if name.lower() in s.relation.columns]
        if listed:
            joined = [s for s in listed if not s.names]
            if joined or len(listed) == 1:
                return (joined or listed)[0].relation.find(name) or {}
            self.ambiguous.append(name)
            return {}
        if (earlier := before.columns.get(name.lower())) is not None:
            return earlier[1]
        unknown = [s for s in found if s.relation.open]
        if len(unknown) == 1:
            return unknown[0].relation.find(name) or {}
        if unknown:
            self.ambiguous.append(name)
        return {}

    def expression(self, e: Node, found: list[Source], before: Relation, kind: str) -> Origins:
        """Base columns of an expression. What is done last counts; plain columns keep what was done before."""
        values, keys = attributes(e)
        text = sql_of(e)
        if not values and not keys:
            return {} if subqueries(e) or existence(e) else {(LITERAL_MODEL, text): Hop("literal", text)}
        out: Origins = {}
        bare: Origins = {}
        for a in values or keys:
            for key, hop in self.column(a, found, before).items():
                if key[0] == LITERAL_MODEL and hop.type == "literal" and key[1].upper() in BARE:
                    bare.setdefault(key, Hop("literal", key[1]))
                    continue
                if kind in TRIVIAL and self.field(a, found):
                    new = Hop("complex", text, (*hop.chain, (key[1], text, "complex")))
                elif kind in TRIVIAL:
                    new = Hop(hop.type if hop.type not in TRIVIAL else kind, hop.sql if hop.type not in TRIVIAL else text, (*hop.chain, (text, text, kind)))
                else:
                    new = Hop(kind, text, (*hop.chain, (key[1], text, kind)))
                out.setdefault(key, new)
        return out or bare

    @staticmethod
    def field(a: Node, found: list[Source]) -> bool:
        """Whether a name of several parts is a field of a column, not a column of a source."""
        parts = a.parts("nameParts")
        prefixes = {".".join(parts[:k]).lower() for k in range(1, len(parts))}
        qualified = [k for s in found for k in prefixes & s.names]
        return len(parts) > 1 and (not qualified or max(k.count(".") for k in qualified) + 2 < len(parts))


def jinja(sql: str) -> bool:
    """Whether templates are left in the SQL."""
    return "{{" in sql or "{%" in sql


def analyze_sql(spark: SparkSession, sql: str, model: str, schema: dict[str, dict[str, str]] | None = None, lookup: dict[str, str] | None = None, *, dialect: str | None = None, unique_id: str = "", max_columns: int | None = None) -> Analysis:
    """Edges into a model from its SQL. SQL that is empty, holds templates or can't be parsed has none."""
    result = Analysis()
    if not (sql or "").strip() or jinja(sql):
        return result
    try:
        plan = parse(spark, sql, dialect)
    except SqlParseError as e:
        result.error = str(e)
        return result
    schema, lookup = schema or {}, lookup or {}
    a = Analyzer(schema, lookup)
    relation = a.query(plan, {})
    result.output_columns = [name for name, _ in relation.columns.values()]
    result.columns_attempted = len(relation.columns)
    seen: set[tuple] = set()
    for name, origins in list(relation.columns.values())[:max_columns]:
        if not origins:
            result.failed_columns.append(name)
        for (source, column), hop in origins.items():
            kind = hop.type if hop.type not in TRIVIAL else ("passthrough" if column.lower() == name.lower() else "rename")
            key = (source, column, model, name)
            if key not in seen:
                seen.add(key)
                result.edges.append({"source_model": source, "source_column": column, "target_model": model, "target_column": name, "transform_type": kind, "transform_sql": hop.sql if kind not in TRIVIAL else column, "transform_chain": [{"step": s, "sql": q, "type": t} for s, q, t in hop.chain], "model_unique_id": unique_id, "resolution_status": "resolved"})
    result.ambiguous_columns = list(dict.fromkeys(a.ambiguous))
    known = {t: c for t in a.tables if (c := schema.get(t) or schema.get(t.lower()))}
    sources = {e["source_model"] for e in result.edges} - {LITERAL_MODEL}
    if len(known) == 1 and not sources & known.keys():
        (table, columns), names = next(iter(known.items())), result.output_columns
        lower = {c.lower(): c for c in columns if "." not in c}
        passed = lambda pairs: [{"source_model": table, "source_column": c, "target_model": model, "target_column": n, "transform_type": "passthrough", "transform_sql": c, "transform_chain": [], "model_unique_id": unique_id, "resolution_status": "resolved"} for c, n in pairs]
        if sources and names and all(n.lower() in lower for n in names):
            # every source is unknown but one known table is read: outputs among its columns pass from it
            result.edges = passed((lower[n.lower()], n) for n in names)
        elif len(a.tables) == 1 and not result.edges:
            # nothing could be traced, and one known table is all that is read: its columns pass
            result.edges = passed((c, c) for c in lower.values())
            result.columns_attempted = len(lower)
    result.columns_traced = len({e["target_column"] for e in result.edges})
    result.unresolved_columns = [c for c in result.failed_columns if c not in result.ambiguous_columns]
    return result
