"""Adapters, dialects, and the rewriting of foreign SQL into what Spark's parser takes."""

from __future__ import annotations

import re

#: The dialect of each adapter.
DIALECTS = {
    "snowflake": "snowflake",
    "bigquery": "bigquery",
    "postgres": "postgres",
    "redshift": "redshift",
    "databricks": "databricks",
    "duckdb": "duckdb",
    "trino": "trino",
    "spark": "spark",
    "clickhouse": "clickhouse",
    "mysql": "mysql",
    "mssql": "tsql",
    "sqlserver": "tsql",
    "athena": "presto",
    "presto": "presto",
}
#: Dialects in which double quotes hold identifiers.
DOUBLE_QUOTED = frozenset(("postgres", "redshift", "snowflake", "duckdb", "trino", "presto", "oracle", "tsql"))
#: Dialects in which a colon after a column begins a path into it.
COLON_PATHS = frozenset(("snowflake", "databricks"))
#: Spark's name for the types of other systems; types of several words are joined by a blank. Others pass if Spark knows them, else they are strings.
TYPES = {
    "BOOL": "BOOLEAN", "BIT": "BOOLEAN",
    "INT2": "SMALLINT", "INT4": "INT", "INT8": "BIGINT", "INT64": "BIGINT", "UINTEGER": "BIGINT", "UNSIGNED": "BIGINT", "SIGNED": "BIGINT", "HUGEINT": "DECIMAL(38,0)", "UBIGINT": "DECIMAL(38,0)",
    "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "FLOAT64": "DOUBLE", "DOUBLE PRECISION": "DOUBLE",
    "NUMBER": "DECIMAL(38,9)", "NUMERIC": "DECIMAL(38,9)", "DECIMAL": "DECIMAL(38,9)", "BIGNUMERIC": "DECIMAL(38,9)", "MONEY": "DECIMAL(19,4)",
    "BYTES": "BINARY", "BYTEA": "BINARY", "BLOB": "BINARY", "VARBINARY": "BINARY",
    "DATETIME": "TIMESTAMP", "DATETIME2": "TIMESTAMP", "SMALLDATETIME": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "TIMESTAMP_TZ": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
}
SPARK_TYPES = frozenset("BOOLEAN TINYINT SMALLINT INT INTEGER BIGINT FLOAT REAL DOUBLE DATE TIMESTAMP TIMESTAMP_NTZ TIMESTAMP_LTZ BINARY STRING BYTE SHORT LONG".split())
MANY_WORDS = (("DOUBLE", "PRECISION"), ("CHARACTER", "VARYING"), ("TIMESTAMP", "WITH", "TIME", "ZONE"), ("TIMESTAMP", "WITHOUT", "TIME", "ZONE"), ("TIME", "WITH", "TIME", "ZONE"), ("TIME", "WITHOUT", "TIME", "ZONE"))
TOKEN = re.compile(
    r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z_0-9]*|\$[0-9]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    r"|\s+|::|#>>|->>|->|=>|!~\*|~\*|!~|<=>|<=|>=|<>|!=|\|\||.",
    re.S,
)


def dialect_of(adapter: str | None) -> str | None:
    """The dialect of an adapter, None for unknown ones."""
    return DIALECTS.get((adapter or "").lower())


def tokens(sql: str) -> list[str]:
    """Strings, identifiers, words, blanks and single characters; comments become a blank."""
    return [" " if t.startswith(("--", "/*")) else t for t in TOKEN.findall(sql)]


def clause_end(toks: list[str], at: int, stop: frozenset[str]) -> int:
    """First position from at, at the same depth, of a stop word, a closing parenthesis or a semicolon."""
    depth = 0
    for i in range(at, len(toks)):
        t = toks[i]
        if depth == 0 and (t in (")", ";") or t.upper() in stop):
            return i
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
    return len(toks)


AFTER_QUALIFY = frozenset(("ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW"))


def without_qualify(toks: list[str]) -> list[str]:
    """QUALIFY clauses taken out: they filter rows and are no sources of columns."""
    out, i = [], 0
    while i < len(toks):
        if toks[i].upper() == "QUALIFY":
            i = clause_end(toks, i + 1, AFTER_QUALIFY)
        else:
            out.append(toks[i])
            i += 1
    return out


def plain_aggregates(toks: list[str]) -> list[str]:
    """ORDER BY and LIMIT inside the parentheses of ..._agg functions taken out."""
    out: list[str] = []
    opened: list[bool] = []
    i = 0
    while i < len(toks):
        t = toks[i]
        if t == "(":
            before = next((x for x in reversed(out) if not x.isspace()), "")
            opened.append(before.lower().endswith("_agg"))
        elif t == ")" and opened:
            opened.pop()
        elif opened and opened[-1] and t.upper() in ("ORDER", "LIMIT"):
            i = clause_end(toks, i, frozenset())
            continue
        out.append(t)
        i += 1
    return out


def _next(toks: list[str], at: int) -> int:
    """The first position from at that isn't blank."""
    while at < len(toks) and toks[at].isspace():
        at += 1
    return at


def _word(toks: list[str], at: int) -> str:
    return toks[at].upper() if at < len(toks) else ""


def _close(toks: list[str], at: int) -> int:
    """The position of the bracket that closes the one at a position."""
    depth = 0
    for i in range(at, len(toks)):
        depth += (toks[i] in "([") - (toks[i] in ")]") if len(toks[i]) == 1 else 0
        if depth == 0:
            return i
    return len(toks) - 1


def _last(out: list[str]) -> int:
    """The last position that isn't blank, -1 for none."""
    i = len(out) - 1
    while i >= 0 and out[i].isspace():
        i -= 1
    return i


def _name(token: str) -> bool:
    return bool(re.match(r"[A-Za-z_`]", token))


def _ends_operand(out: list[str]) -> bool:
    t = out[_last(out)] if _last(out) >= 0 else ""
    return t in (")", "]") or t[:1] in "'`\"" and t != "" or bool(re.match(r"\w", t)) and t.upper() not in CLAUSES | {"AND", "OR", "NOT", "THEN", "ELSE", "WHEN", "CASE", "IN", "LIKE", "BY"}


def _operand(out: list[str]) -> int:
    """Where the operand begins that ends the tokens: a name with its qualifiers, a call, something in parentheses, a constant."""
    i = _last(out)
    while True:
        if out[i] in (")", "]"):
            depth = 0
            while i >= 0:
                depth += (out[i] in ")]") - (out[i] in "([") if len(out[i]) == 1 else 0
                if depth == 0:
                    break
                i -= 1
            before = _last(out[:i])
            if before >= 0 and _name(out[before]) and out[before].upper() not in CLAUSES | {"IN", "AND", "OR", "NOT", "AS"}:
                i = before
        before = _last(out[:i])
        if before >= 0 and out[before] in (".", "::"):
            i = _last(out[:before])
            continue
        return i


CLAUSES = frozenset("SELECT FROM JOIN WHERE ON GROUP ORDER HAVING UNION LIMIT USING QUALIFY WINDOW".split())


def _in_from(out: list[str]) -> bool:
    """Whether the next token stands in a FROM clause, at the depth of the end."""
    depth = 0
    for t in reversed(out):
        if len(t) == 1 and t in ")]":
            depth += 1
        elif len(t) == 1 and t in "([":
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and t.upper() in CLAUSES:
            return t.upper() in ("FROM", "JOIN", "ON", "USING")
    return False


def _type(toks: list[str], at: int) -> tuple[str, int]:
    """Spark's name of the type at a position, and where it ends."""
    at = _next(toks, at)
    words, end = [_word(toks, at)], at + 1
    if words[0] in ("ARRAY", "STRUCT", "MAP") and _word(toks, _next(toks, end)) == "<":
        depth, i = 0, _next(toks, end)
        while i < len(toks):
            depth += (toks[i] == "<") - (toks[i] == ">")
            i += 1
            if depth == 0:
                break
        return "".join(toks[at:i]), i
    params = ""
    if _word(toks, end) == "(":
        close = _close(toks, end)
        params, end = "".join(toks[end : close + 1]), close + 1
    for many in MANY_WORDS:
        got, i = [words[0]], end
        while len(got) < len(many):
            i = _next(toks, i)
            got.append(_word(toks, i))
            i += 1
        if tuple(got) == many:
            words, end = got, i
            if _word(toks, end) == "(":
                end = _close(toks, end) + 1
    name = " ".join(words)
    found = TYPES.get(name) or (name if name in SPARK_TYPES else "STRING")
    if found.startswith("DECIMAL") and params:
        found = "DECIMAL" + params
    while _word(toks, end) == "[" and _word(toks, _next(toks, end + 1)) == "]":
        found, end = f"ARRAY<{found}>", _next(toks, end + 1) + 1
    return found, end


def _star(toks: list[str], at: int, qualifier: str) -> tuple[list[str], int]:
    """EXCLUDE, EXCEPT, REPLACE and RENAME behind a star, as EXCEPT and further columns."""
    names, more = [], []
    while True:
        i = _next(toks, at)
        word, then = _word(toks, i), _next(toks, i + 1)
        listed = _word(toks, then) == "("
        if word not in ("EXCLUDE", "EXCEPT", "REPLACE", "RENAME") or not (listed or word == "EXCLUDE" and then < len(toks)) or word == "EXCEPT" and _word(toks, _next(toks, then + 1)) in ("SELECT", "WITH", "("):
            break
        end = _close(toks, then) if listed else then
        items, part, depth = [], [], 0
        for t in toks[then + 1 : end] if listed else [toks[then]]:
            depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
            if t == "," and depth == 0:
                items.append(part)
                part = []
            else:
                part.append(t)
        for item in [*items, part]:
            text = "".join(item).strip()
            last = [t for t in item if not t.isspace()][-1] if word == "REPLACE" else next(t for t in item if not t.isspace())
            names.append(last)
            if word != "EXCLUDE" and word != "EXCEPT":
                more.append((qualifier if word == "RENAME" else "") + text)
        at = end + 1
    if not names:
        return [], at
    return [" EXCEPT (", ", ".join(names), ")", *(f", {m}" for m in more)], at


def _alias(toks: list[str], at: int) -> tuple[str | None, list[str], int]:
    """An alias at a position: name, column names, where it ends."""
    i = _next(toks, at)
    if _word(toks, i) == "AS":
        i = _next(toks, i + 1)
    if i >= len(toks) or not _name(toks[i]) or toks[i].upper() in CLAUSES | {"LEFT", "RIGHT", "INNER", "FULL", "CROSS", "WITH", "LATERAL", "NATURAL", "OUTER"}:
        return None, [], at
    then = _next(toks, i + 1)
    if _word(toks, then) == "(":
        end = _close(toks, then)
        return toks[i], [t for t in toks[then + 1 : end] if _name(t)], end + 1
    return toks[i], [], i + 1


def _exploded(toks: list[str], at: int, out: list[str]) -> tuple[list[str], int]:
    """UNNEST(...) or FLATTEN(...) at a position, with what follows it, as a call of EXPLODE."""
    flat = _word(toks, at) == "FLATTEN"
    begin = _next(toks, at + 1)
    end = _close(toks, begin)
    inner = toks[begin + 1 : end]
    if flat:
        parts, part, depth = [], [], 0
        for t in [*inner, ","]:
            depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
            if t == "," and depth == 0:
                parts.append(part)
                part = []
            else:
                part.append(t)
        named = [p for p in parts if _word(p, _next(p, 0)) == "INPUT"]
        inner = named[0][next(i for i, t in enumerate(named[0]) if t == "=>") + 1 :] if named else parts[0]
    argument = _rewritten(inner, None)
    if not flat and not _in_from(out):
        return ["EXPLODE", "(", *argument, ")"], end + 1
    if flat and toks[end + 1 : end + 2] == [")"] and out and "TABLE" in (t.upper() for t in out[-3:]):
        end += 1  # TABLE(FLATTEN(...))
        while out and out[-1].upper() != "TABLE":
            out.pop()
        out.pop()
    place = None
    alias, columns, after = _alias(toks, end + 1)
    i = _next(toks, after)
    if _word(toks, i) == "WITH" and _word(toks, _next(toks, i + 1)) in ("OFFSET", "ORDINALITY"):
        ordinal = _word(toks, _next(toks, i + 1)) == "ORDINALITY"
        name, more, after = _alias(toks, _next(toks, i + 1) + 1)
        if ordinal:
            alias, columns = name or alias, more or columns
            place = columns.pop() if len(columns) > 1 else "ordinality"
        else:
            place = name or "offset"
    alias = alias or "_unnested"
    columns = columns[:1] or (["value"] if flat else [alias])
    first = _last(out) < 0 or out[_last(out)].upper() == "FROM"
    lateral = "" if first or out[_last(out)].upper() == "LATERAL" else "LATERAL "
    call = "POSEXPLODE(" if place else "EXPLODE("
    return [lateral, call, *argument, f") AS {alias}({', '.join([place, *columns] if place else columns)})"], after


def _rewritten(toks: list[str], dialect: str | None) -> list[str]:
    """Tokens of a dialect as Spark's parser takes them."""
    out: list[str] = []
    calls: list[str] = []  # what stands before each open parenthesis
    i = 0
    while i < len(toks):
        t, word = toks[i], toks[i].upper()
        then = _next(toks, i + 1)
        after = _word(toks, then)
        back = out[_last(out)].upper() if _last(out) >= 0 else ""
        if t.startswith("`") and "." in t:
            t = ".".join(f"`{p}`" for p in t[1:-1].split("."))
        elif t.startswith('"') and dialect in DOUBLE_QUOTED:
            t = "`" + t[1:-1].replace('""', '"') + "`"
        elif t == "[" and dialect == "tsql" and "]" in toks[i:]:
            end = toks.index("]", i)
            t, i = "`" + "".join(toks[i + 1 : end]) + "`", end
        elif re.fullmatch(r"\$[0-9]+", t):
            t = f"`{t}`"
        elif word == "SAFE_CAST":
            t = "TRY_CAST"
        elif word == "TOP" and back in ("SELECT", "DISTINCT") and (after == "(" or after.isdigit()):
            i = (_close(toks, then) if after == "(" else then) + 1
            if _word(toks, _next(toks, i)) == "PERCENT":
                i = _next(toks, i) + 1
            continue
        elif word == "ON" and back == "DISTINCT" and after == "(":
            i = _close(toks, then) + 1
            continue
        elif word in ("EXCLUDE", "EXCEPT", "REPLACE", "RENAME") and back == "*":
            star = _last(out)
            dot = _last(out[:star])
            qualifier = out[_last(out[:dot])] + "." if dot > 0 and out[dot] == "." else ""
            found, end = _star(toks, i, qualifier)
            if found:
                out += [found[0], *_rewritten(tokens("".join(found[1:])), dialect)]
                i = end
                continue
        elif t in ("->>", "#>>") or t == "->" and (after[:1] == "'" or after.isdigit()):
            k = _operand(out)
            out[k:] = ["GET_JSON_OBJECT", "(", *out[k:], ", ", toks[then] if after[:1] == "'" else f"'{toks[then]}'", ")"]
            i = then + 1
            continue
        elif t in ("~", "~*", "!~", "!~*") and _ends_operand(out):
            t = " NOT RLIKE " if t[0] == "!" else " RLIKE "
        elif t == ":" and dialect in COLON_PATHS and _ends_operand(out) and re.match(r"[A-Za-z_'`\"]", after or " "):
            end = then + 1
            while end < len(toks) and (toks[end] == "." and _name(toks[end + 1] if end + 1 < len(toks) else "") or toks[end] == "["):
                end = _close(toks, end) + 1 if toks[end] == "[" else end + 2
            path = "".join(toks[then:end]).replace("'", "").replace('"', "")
            k = _operand(out)
            out[k:] = ["GET_JSON_OBJECT", "(", *out[k:], ", ", f"'$.{path}'", ")"]
            i = end
            continue
        elif word == "MATERIALIZED" and back in ("AS", "NOT") and after == "(":
            if back == "NOT":
                del out[_last(out) :]
            i = then
            continue
        elif word == "LIMIT" and after.isdigit() and _word(toks, _next(toks, then + 1)) == ",":
            out.append(t + " ")
            i = _next(toks, _next(toks, then + 1) + 1)
            continue
        elif word == "FETCH" and after in ("FIRST", "NEXT"):
            while i < len(toks) and toks[i].upper() not in ("ONLY", "TIES"):
                i += 1
            i += 1
            continue
        elif word in ("ROW", "ROWS") and len(out) > 2 and re.fullmatch(r"[0-9]+", back) and "OFFSET" in (x.upper() for x in out[-4:]):
            i += 1
            continue
        elif word == "ARRAY" and after == "(" and _word(toks, _next(toks, then + 1)) in ("SELECT", "WITH"):
            i = then
            continue
        elif word == "FOR" and after == "SYSTEM_TIME":
            i = clause_end(toks, i + 1, frozenset("JOIN LEFT RIGHT INNER FULL CROSS WHERE GROUP ORDER ON UNION LIMIT QUALIFY".split()) | {","})
            continue
        elif word in ("AT", "BEFORE") and after == "(" and _in_from(out) and dialect == "snowflake":
            i = _close(toks, then) + 1
            continue
        elif word == "AT" and after == "TIME" and _word(toks, _next(toks, then + 1)) == "ZONE":
            zone = _next(toks, _next(toks, then + 1) + 1)
            k = _operand(out)
            out[k:] = ["FROM_UTC_TIMESTAMP", "(", *out[k:], ", ", toks[zone] if zone < len(toks) else "''", ")"]
            i = zone + 1
            continue
        elif word in ("UNNEST", "FLATTEN") and after == "(":
            found, i = _exploded(toks, i, out)
            out += found
            continue
        elif word == "SIMILAR" and after == "TO":
            t, i = "RLIKE", then
        elif word == "CONVERT" and dialect == "tsql" and after == "(":
            kind, end = _type(toks, then + 1)
            comma, close = _next(toks, end), _close(toks, then)
            stop, depth = close, 0
            for k in range(comma + 1, close):
                depth += (toks[k] in "([") - (toks[k] in ")]") if len(toks[k]) == 1 else 0
                if toks[k] == "," and depth == 0:
                    stop = k
                    break
            out += ["CAST", "(", *_rewritten(toks[comma + 1 : stop], dialect), " AS ", kind, ")"]
            i = close + 1
            continue
        elif t == "::" or word == "AS" and calls and calls[-1] in ("CAST", "TRY_CAST"):
            kind, end = _type(toks, i + 1)
            out += ["::" if t == "::" else " AS ", kind]
            i = end
            continue
        elif t == "(":
            calls.append(back)
        elif t == ")" and calls:
            calls.pop()
        out.append(t)
        i += 1
    return out


def to_spark(sql: str, dialect: str | None = None) -> str:
    """SQL of a dialect in Spark's words, for parsing only."""
    return "".join(_rewritten(plain_aggregates(without_qualify(tokens(sql))), dialect)).strip().rstrip(";")


def qualify_to_filter(sql: str) -> str:
    """The outermost SELECT ... QUALIFY cond as a filter over a subquery, for running on Spark."""
    toks = tokens(sql)
    depth, select, start = 0, None, None
    for i, t in enumerate(toks):
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if depth == 0 and t.upper() == "SELECT":
            select = i
        if depth == 0 and t.upper() == "FROM" and start is None and select is not None:
            start = i
        if depth == 0 and t.upper() == "QUALIFY":
            end = clause_end(toks, i + 1, AFTER_QUALIFY)
            part = "".join
            inner = f"{part(toks[select:start])}, ({part(toks[i + 1 : end]).strip()}) AS _qualified {part(toks[start:i])}"
            return f"{part(toks[:select])}SELECT * EXCEPT (_qualified) FROM ({inner}) WHERE _qualified {part(toks[end:])}"
    return sql
