"""From syntax trees to DataFrames.

Expressions become columns typed by Spark's own analysis, so integer division
and text joining follow their operands; queries become plain DataFrame calls
that Catalyst plans.
"""

from __future__ import annotations

import copy
import dataclasses
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import aggregates, conversion, datetime, logic, numeric, strings
from ..operators.nested import explode_paths, repeated_root
from ..operators.timewindow import sliding_windows, time_span
from . import ast

VERSION = "1.0"


@dataclasses.dataclass
class Environment:
    """What names mean: tables, and functions that users have added."""

    spark: SparkSession
    table: Callable[..., DataFrame]
    functions: dict[str, Callable[..., Column]] = dataclasses.field(default_factory=dict)
    aggregates: dict[str, Callable[..., Column]] = dataclasses.field(default_factory=dict)


def raise_clear(e: AnalysisException):
    """Spark's message about an unknown column or table, in one line."""
    text = str(e)
    if m := re.search(r"UNRESOLVED_COLUMN[^\]]*\].*?with name `?([^ ]*?)`? cannot be resolved", text):
        raise QueryError(f"no such column: '{m[1].replace('`', '')}'") from None
    if m := re.search(r"TABLE_OR_VIEW_NOT_FOUND\] The table or view `?([^ ]*?)`? cannot", text):
        raise QueryError(f"table not found: '{m[1].replace('`', '')}'") from None
    raise QueryError(text.split("\n")[0]) from None


class Scope:
    """The columns that an expression can name."""

    def __init__(self, env: Environment, df: DataFrame, tables: list[tuple[str | None, list[str]]], replaced: dict[tuple[str, ...], str] | None = None):
        self.env, self.df, self.tables, self.replaced = env, df, tables, replaced or {}

    def kind(self, c: Column) -> T.DataType:
        try:
            return self.df.select(c.alias("x")).schema[0].dataType
        except AnalysisException as e:
            raise_clear(e)

    def ref(self, parts: list[str]) -> Column:
        low = tuple(p.lower() for p in parts)
        names = {(a or "").lower() for a, _ in self.tables}
        for path, name in self.replaced.items():
            for skip in (0, 1):
                own = low[skip:]
                if (skip == 0 or low[0] in names) and own[: len(path)] == path:
                    return F.col(".".join(f"`{p}`" for p in [name, *parts[skip + len(path) :]]))
        return F.col(".".join(f"`{p}`" for p in parts))


def literal(node, what: str):
    if not isinstance(node, ast.Lit):
        raise QueryError(f"{what} must be a literal")
    return node.value


def compile_expr(node, scope: Scope) -> Column:
    if isinstance(node, ast.Lit):
        return F.lit(node.value)
    if isinstance(node, ast.Ref):
        return scope.ref(node.parts)
    if isinstance(node, ast.Op):
        return _operator(node, scope)
    if isinstance(node, ast.Call):
        return _call(node, scope)
    raise QueryError("* is not an expression")


def _whole(scope: Scope, *cols: Column) -> bool:
    return all(numeric.is_integer(scope.kind(c)) for c in cols)


def _operator(node: ast.Op, scope: Scope) -> Column:
    args = [compile_expr(a, scope) for a in node.args]
    op = node.op
    if op == "in":
        return args[0].isin(*args[1:])
    simple = {
        "=": logic.eq, "!=": logic.neq, "<": logic.lt, "<=": logic.lte, ">": logic.gt, ">=": logic.gte,
        "and": logic.logical_and, "or": logic.logical_or, "not": logic.negation, "isnull": logic.isnull,
        "like": strings.like, "regexp": strings.regexp, "negate": lambda a: -a, "~": F.bitwise_not,
        "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b),
        "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
    }
    if op in simple:
        return simple[op](*args)
    a, b = args
    kinds = [scope.kind(a), scope.kind(b)]
    if op == "+" and any(isinstance(k, T.StringType) for k in kinds):
        return strings.concat(a.cast("string"), b.cast("string"))
    whole = all(numeric.is_integer(k) for k in kinds)
    if whole:
        a, b = a.cast("bigint"), b.cast("bigint")
    table = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: numeric.div(a, b, whole), "div": lambda: numeric.div(a, b, True), "%": lambda: numeric.mod(a, b, whole), "^": lambda: numeric.power(a, b, whole)}
    return table[op]()


#: Functions of plain columns.
SIMPLE: dict[str, Callable[..., Column]] = {
    "lcase": strings.lower, "lowercase": strings.lower, "ucase": strings.upper, "uppercase": strings.upper,
    "startswith": strings.startswith, "endswith": strings.endswith, "ltrim": strings.ltrim, "rtrim": strings.rtrim,
    "substring": strings.substring, "substr": strings.substring, "concat": strings.concat, "fnv32": strings.fnv32,
    "eq": logic.eq, "neq": logic.neq, "lt": logic.lt, "lte": logic.lte, "gt": logic.gt, "gte": logic.gte,
    "logical_and": logic.logical_and, "logical_or": logic.logical_or, "neg": logic.negation, "cmp": logic.cmp,
    "isnull": logic.isnull, "if": logic.if_, "truncate": numeric.truncate, "now": datetime.now,
    "to_nil": conversion.to_nil, "to_timestamp64": conversion.to_timestamp64, "from_timestamp": datetime.from_timestamp,
}
#: Functions that also need their first argument's type.
TYPED: dict[str, Callable[..., Column]] = {
    "to_int64": conversion.to_int64, "to_int": conversion.to_int64, "to_float": conversion.to_float,
    "to_string": conversion.to_string, "to_str": conversion.to_string, "to_bool": conversion.to_bool,
}
ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%", "pow": "^"}


def _time(node, scope: Scope) -> Column:
    return datetime.time_at(node.value) if isinstance(node, ast.Lit) and isinstance(node.value, str) else compile_expr(node, scope)


def _call(node: ast.Call, scope: Scope) -> Column:
    name, args = node.name, node.args
    if node.within_record:
        if len(args) != 1 or not isinstance(args[0], ast.Ref):
            raise QueryError("WITHIN RECORD takes one column")
        whole = Scope(scope.env, scope.df, scope.tables)
        values = whole.ref(args[0].parts)
        kind = whole.kind(values)
        return aggregates.within_record(name, values, isinstance(kind, T.ArrayType) and numeric.is_integer(kind.elementType))
    try:
        if name in scope.env.functions:
            return scope.env.functions[name](*[compile_expr(a, scope) for a in args])
        if name in SIMPLE:
            return SIMPLE[name](*[compile_expr(a, scope) for a in args])
        if name in TYPED:
            c = compile_expr(args[0], scope)
            return TYPED[name](c, scope.kind(c))
        if name in ARITHMETIC and len(args) == 2:
            return _operator(ast.Op(ARITHMETIC[name], args), scope)
        if name == "round":
            return numeric.round_(compile_expr(args[0], scope), literal(args[1], "the number of digits") if len(args) > 1 else 0)
        if name == "date_trunc":
            return datetime.date_trunc(literal(args[0], "the time window"), _time(args[1], scope))
        if name in ("date_add", "date_sub"):
            return getattr(datetime, name)(_time(args[0], scope), literal(args[1], "the interval"), literal(args[2], "the unit"))
        if name == "time_at":
            return datetime.time_at(str(args[0].value) if isinstance(args[0], ast.Lit) else compile_expr(args[0], scope))
        if name == "version":
            return F.lit(VERSION)
    except (TypeError, IndexError):
        raise QueryError(f"wrong number of arguments for {name}") from None
    if name in aggregates.AGGREGATES or name in scope.env.aggregates:
        raise QueryError(f"aggregate {name} is not allowed here")
    if scope.env.spark.catalog.functionExists(name):
        return F.call_function(name, *[compile_expr(a, scope) for a in args])
    raise QueryError(f"unknown function: {name}")


# -- sources
def walk(node):
    """Every node of an expression."""
    yield node
    for child in getattr(node, "args", []) or []:
        yield from walk(child)


_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


def _bounds(where, table: ast.Table, env: Environment) -> dict[str, list[tuple[str, Callable[[], Column]]]]:
    """By column: comparisons with constants, read as times when asked for, that all rows of a WHERE clause meet."""
    out: dict[str, list[tuple[str, Callable[[], Column]]]] = {}
    if isinstance(where, ast.Op) and where.op == "and":
        for side in where.args:
            for c, found in _bounds(side, table, env).items():
                out.setdefault(c, []).extend(found)
    elif isinstance(where, ast.Op) and where.op in _MIRROR:
        for op, a, b in ((where.op, *where.args), (_MIRROR[where.op], *reversed(where.args))):
            own = isinstance(a, ast.Ref) and (len(a.parts) == 1 or a.parts[:-1] == [table.alias or table.name.split(".")[-1]])
            if own and not any(isinstance(n, ast.Ref | ast.Star) or _is_aggregate(n, env) for n in walk(b)):
                out.setdefault(a.parts[-1].lower(), []).append((op, lambda b=b: _time(b, Scope(env, env.spark.range(1), []))))
    return out


def _source(node, env: Environment, where=None) -> tuple[DataFrame, list[tuple[str | None, list[str]]]]:
    if node is None:
        return env.spark.range(1).select(), []
    if isinstance(node, ast.Table):
        df = env.table(node.name, _bounds(where, node, env)) if where is not None else env.table(node.name)
        alias = node.alias or node.name.split(".")[-1]
        return df.alias(alias), [(alias, df.columns)]
    if isinstance(node, ast.Derived):
        df = build_query(node.query, env)
        return (df.alias(node.alias), [(node.alias, df.columns)]) if node.alias else (df, [(None, df.columns)])
    left, lt = _source(node.left, env)
    right, rt = _source(node.right, env)
    shared = node.using
    if node.natural:
        there = {c.lower() for _, cs in rt for c in cs}
        shared = [c for _, cs in lt for c in cs if c.lower() in there]
    if shared:
        return left.join(right, shared, node.kind if node.kind != "cross" else "inner"), [(None, shared), *_without(lt, shared), *_without(rt, shared)]
    tables = lt + rt
    if node.on is None:
        if node.kind in ("left", "right"):
            raise QueryError(f"{node.kind.upper()} JOIN needs a condition")
        return left.crossJoin(right), tables
    both = Scope(env, left.crossJoin(right), tables)
    return left.join(right, compile_expr(node.on, both), "inner" if node.kind == "cross" else node.kind), tables


def _without(tables, names: list[str]):
    low = {n.lower() for n in names}
    return [(a, [c for c in cs if c.lower() not in low]) for a, cs in tables]


def _stars(items: list[ast.Item], tables) -> list[ast.Item]:
    """Items with each * replaced by the columns it stands for; a name met before gets its table's."""
    out, seen = [], set()
    for item in items:
        if not isinstance(item.expr, ast.Star):
            out.append(item)
            continue
        want = item.expr.table
        found = [(a, cs) for a, cs in tables if want is None or (a or "").lower() == want.lower()]
        if not found:
            raise QueryError(f"table not found: '{want}'" if want else "SELECT * needs a FROM clause")
        for a, cs in found:
            for c in cs:
                name = c if c.lower() not in seen else f"{a}.{c}"
                seen.add(c.lower())
                out.append(ast.Item(ast.Ref([a, c] if a else [c]), name, name))
    return out


def name_of(item: ast.Item) -> str:
    if item.alias:
        return item.alias
    return item.expr.parts[-1] if isinstance(item.expr, ast.Ref) else item.text


# -- queries
def build_query(node, env: Environment) -> DataFrame:
    try:
        if isinstance(node, ast.Union):
            out = build_query(node.parts[0], env)
            for part, every in zip(node.parts[1:], node.every, strict=True):
                out = out.union(build_query(part, env))
                out = out if every else out.distinct()
            return _tail(out, node)
        return _select(node, env)
    except AnalysisException as e:
        raise_clear(e)


def _is_aggregate(node, env: Environment) -> bool:
    return isinstance(node, ast.Call) and not node.within_record and (node.name in aggregates.AGGREGATES or node.name in env.aggregates)


def _select(sel: ast.Select, env: Environment) -> DataFrame:
    if sel.window and isinstance(sel.source, ast.Join):
        return _joined_windows(sel, env)
    df, tables = _source(sel.source, env, sel.where)
    items = _stars(sel.items, tables)
    if not items:
        raise QueryError("SELECT needs a list of expressions")
    df, replaced = _flatten(df, tables, sel, items, env)
    scope = Scope(env, df, tables, replaced)
    if sel.where is not None:
        df = df.filter(compile_expr(sel.where, scope))
        scope = Scope(env, df, tables, replaced)
    if sel.window:
        out = _windowed(sel, items, scope)
        return _tail(out.distinct() if sel.distinct else out, sel)
    nodes = [i.expr for i in items] + [e for e, _ in sel.order] + ([sel.having] if sel.having is not None else [])
    if sel.group is not None or any(_is_aggregate(n, env) for x in nodes for n in walk(x)):
        return _grouped(sel, items, scope)
    if sel.having is not None:
        raise QueryError("HAVING needs a grouped query")
    cols = [compile_expr(i.expr, scope).alias(name_of(i)) for i in items]
    order = [_sorted(compile_expr(_unalias(e, items, df.columns), scope), up) for e, up in sel.order]
    if sel.distinct:
        out = df.select(*cols).distinct()
        return _tail(out, sel)
    out = df.orderBy(*order).select(*cols) if order else df.select(*cols)
    return _limited(out, sel)


def _flatten(df: DataFrame, tables, sel: ast.Select, items: list[ast.Item], env: Environment):
    """Rows for the repeated columns that are named outside of WITHIN RECORD."""
    exprs = [i.expr for i in items if not (isinstance(i.expr, ast.Ref) and any(i.expr.parts[-1:] == [c] and isinstance(s.expr, ast.Star) for s in sel.items for _, cs in tables for c in cs))]
    exprs += [e for e in (sel.where, sel.having) if e is not None] + [e for e, _ in sel.order] + (sel.group or [])
    names = {(a or "").lower() for a, _ in tables}
    found: list[list[str]] = []

    def look(node) -> None:
        if isinstance(node, ast.Call) and node.within_record:
            return
        if isinstance(node, ast.Ref):
            parts = node.parts[1:] if len(node.parts) > 1 and node.parts[0].lower() in names else node.parts
            root = repeated_root(df.schema, parts)
            if root and [p.lower() for p in root] not in [[p.lower() for p in f] for f in found]:
                found.append(root)
        for child in getattr(node, "args", []) or []:
            look(child)

    for e in exprs:
        look(e)
    if not found:
        return df, {}
    labels = ["__" + "__".join(p) for p in found]
    return explode_paths(df, found, labels), {tuple(p.lower() for p in path): n for path, n in zip(found, labels, strict=True)}


def _unalias(node, items: list[ast.Item], columns: list[str]):
    """An output name used in another clause stands for its expression, unless a column has that name."""
    if isinstance(node, ast.Ref) and len(node.parts) == 1 and node.parts[0].lower() not in {c.lower() for c in columns}:
        for i in items:
            if i.alias and i.alias.lower() == node.parts[0].lower():
                return i.expr
    if isinstance(node, ast.Op | ast.Call):
        node = copy.copy(node)
        node.args = [_unalias(a, items, columns) for a in node.args]
    return node


def _sorted(c: Column, up: bool) -> Column:
    return c.asc() if up else c.desc()


def _limited(df: DataFrame, sel: ast.Select | ast.Union) -> DataFrame:
    if sel.offset:
        df = df.offset(sel.offset)
    return df.limit(sel.limit) if sel.limit is not None else df


def _tail(out: DataFrame, sel: ast.Select | ast.Union) -> DataFrame:
    if sel.order:
        scope = Scope(None, out, [(None, out.columns)])
        out = out.orderBy(*[_sorted(compile_expr(e, scope), up) for e, up in sel.order])
    return _limited(out, sel)


def _grouped(sel: ast.Select, items: list[ast.Item], scope: Scope) -> DataFrame:
    df, env = scope.df, scope.env
    group = [_unalias(g, items, df.columns) for g in sel.group or []]
    keys = [compile_expr(g, scope).alias(f"__g{i}") for i, g in enumerate(group)]
    made: list[tuple[object, Column]] = []

    def keep(node, make) -> ast.Ref:
        for i, (n, _) in enumerate(made):
            if n == node:
                return ast.Ref([f"__a{i}"])
        made.append((copy.deepcopy(node), make().alias(f"__a{len(made)}")))
        return ast.Ref([f"__a{len(made) - 1}"])

    def lift(node):
        """The node over the grouped table: keys, aggregates, and any row's value of other columns."""
        for i, g in enumerate(group):
            if _same(node, g, scope):
                return ast.Ref([f"__g{i}"])
        if _is_aggregate(node, env):
            return keep(node, lambda: _aggregate(node, scope))
        if isinstance(node, ast.Ref) or (isinstance(node, ast.Call) and node.within_record):
            return keep(node, lambda: F.any_value(compile_expr(node, scope)))
        if isinstance(node, ast.Op | ast.Call):
            node = copy.copy(node)
            node.args = [lift(a) for a in node.args]
        return node

    out_items = [(lift(i.expr), name_of(i)) for i in items]
    having = lift(_unalias(sel.having, items, df.columns)) if sel.having is not None else None
    order = [(lift(_unalias(e, items, df.columns)), up) for e, up in sel.order]
    aggs = [c for _, c in made]
    if keys:
        table = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    else:
        table = df.agg(*aggs)
    over = Scope(env, table, [(None, table.columns)])
    if having is not None:
        table = table.filter(compile_expr(having, over))
        over = Scope(env, table, over.tables)
    cols = [compile_expr(n, over).alias(name) for n, name in out_items]
    if sel.distinct:
        return _tail(table.select(*cols).distinct(), sel)
    if order:
        table = table.orderBy(*[_sorted(compile_expr(n, over), up) for n, up in order])
    return _limited(table.select(*cols), sel)


def _same(a, b, scope: Scope) -> bool:
    """Whether two expressions are one; a table's name before a column makes no difference."""
    if isinstance(a, ast.Ref) and isinstance(b, ast.Ref):
        names = {(n or "").lower() for n, _ in scope.tables}
        cut = lambda p: [x.lower() for x in (p[1:] if len(p) > 1 and p[0].lower() in names else p)]
        return cut(a.parts) == cut(b.parts) and (len(a.parts) != len(b.parts) or [x.lower() for x in a.parts] == [x.lower() for x in b.parts])
    if type(a) is not type(b) or isinstance(a, ast.Star):
        return False
    if isinstance(a, ast.Op):
        return a.op == b.op and len(a.args) == len(b.args) and all(_same(x, y, scope) for x, y in zip(a.args, b.args, strict=True))
    if isinstance(a, ast.Call):
        return a.name == b.name and a.within_record == b.within_record and len(a.args) == len(b.args) and all(_same(x, y, scope) for x, y in zip(a.args, b.args, strict=True))
    return a == b


def _aggregate(node: ast.Call, scope: Scope) -> Column:
    if node.name == "count" and (not node.args or isinstance(node.args[0], ast.Star)):
        return aggregates.count()
    fn = scope.env.aggregates.get(node.name) or aggregates.AGGREGATES[node.name]
    return fn(*[compile_expr(a, scope) for a in node.args])


# -- time windows
def _windowed(sel: ast.Select, items: list[ast.Item], scope: Scope) -> DataFrame:
    w = sel.window
    aggs: dict[str, tuple[str, Column]] = {}
    made: list[ast.Call] = []

    def lift(node):
        if _same(node, w.time, scope):
            return ast.Ref(["__time"])
        for i, b in enumerate(w.by):
            if _same(node, b, scope):
                return ast.Ref([f"__b{i}"])
        if _is_aggregate(node, scope.env):
            if node not in made:
                made.append(node)
                arg = F.lit(1) if not node.args or isinstance(node.args[0], ast.Star) else compile_expr(node.args[0], scope)
                aggs[f"__w{len(made) - 1}"] = (node.name, arg)
            return ast.Ref([f"__w{made.index(node)}"])
        if isinstance(node, ast.Ref):
            raise QueryError(f"'{'.'.join(node.parts)}' is neither grouped nor aggregated")
        if isinstance(node, ast.Op | ast.Call):
            node = copy.copy(node)
            node.args = [lift(a) for a in node.args]
        return node

    outs = [(lift(i.expr), name_of(i)) for i in items]
    having = lift(_unalias(sel.having, items, scope.df.columns)) if sel.having is not None else None
    if not aggs:
        aggs["__w0"] = ("count", F.lit(1))
    by = {f"__b{i}": compile_expr(b, scope) for i, b in enumerate(w.by)}
    table = sliding_windows(scope.df, compile_expr(w.time, scope), w.size, w.step, by, aggs, "__time", w.span)
    if having is not None:
        table = table.filter(compile_expr(having, Scope(scope.env, table, [(None, table.columns)])))
    over = Scope(scope.env, table, [(None, table.columns)])
    return table.select(*[compile_expr(n, over).alias(name) for n, name in outs])


def _joined_windows(sel: ast.Select, env: Environment) -> DataFrame:
    """Windows over several tables: each is windowed alone, over the time that all of them span, then they are joined on time and keys."""
    tables: list[ast.Table] = []

    def collect(node) -> None:
        if isinstance(node, ast.Join):
            if node.kind != "cross" or node.on is not None or node.using or node.natural:
                raise QueryError("GROUP OVER TIMEWINDOW cannot be mixed with JOIN")
            collect(node.left)
            collect(node.right)
        else:
            tables.append(node)

    collect(sel.source)
    names = [(t.alias or t.name.split(".")[-1]) if isinstance(t, ast.Table) else t.alias for t in tables]
    w = sel.window
    plain = lambda e: ast.Ref(e.parts[1:]) if isinstance(e, ast.Ref) and len(e.parts) > 1 and e.parts[0] in names else e
    time, by = plain(w.time), [plain(b) for b in w.by]
    calls: dict[str, list[ast.Call]] = {n: [] for n in names}
    exprs = [i.expr for i in sel.items] + ([sel.having] if sel.having is not None else [])
    for expr in exprs:
        for node in walk(expr):
            if _is_aggregate(node, env):
                owner = next((n.parts[0] for a in node.args for n in walk(a) if isinstance(n, ast.Ref) and n.parts[0] in names), None)
                if owner is None:
                    raise QueryError("aggregates over several tables must name their table")
                calls[owner].append(node)
    if sel.where is not None:
        raise QueryError("filter the tables of a joined time window in subqueries")
    out = span = None
    for t in tables:
        df, known = _source(t, env)
        one = time_span(df, compile_expr(time, Scope(env, df, known)))
        span = one if span is None else span.union(one)
    for t, n in zip(tables, names, strict=True):
        own = [ast.Item(time, "__time", "")] + [ast.Item(b, f"__b{i}", "") for i, b in enumerate(by)] + [ast.Item(c, f"__{n}{i}", "") for i, c in enumerate(calls[n])]
        one = _select(ast.Select(own, t, None, None, ast.Window(time, w.size, w.step, by, span)), env)
        out = one if out is None else out.join(one, ["__time", *[f"__b{i}" for i in range(len(by))]])

    def lift(node):
        if _is_aggregate(node, env):
            n, i = next((n, cs.index(node)) for n, cs in calls.items() if node in cs)
            return ast.Ref([f"__{n}{i}"])
        if plain(node) == time:
            return ast.Ref(["__time"])
        for i, b in enumerate(by):
            if plain(node) == b:
                return ast.Ref([f"__b{i}"])
        if isinstance(node, ast.Op | ast.Call):
            node = copy.copy(node)
            node.args = [lift(a) for a in node.args]
        return node

    over = Scope(env, out, [(None, out.columns)])
    if sel.having is not None:
        out = out.filter(compile_expr(lift(sel.having), over))
        over = Scope(env, out, [(None, out.columns)])
    out = out.select(*[compile_expr(lift(i.expr), over).alias(name_of(i)) for i in sel.items])
    return _tail(out.distinct() if sel.distinct else out, sel)
