"""Binds a tree to the catalog and lowers it to a DataFrame.

Names, types and placement are checked here, before any Spark job, so errors also show on empty
tables. The physical choices are left to Catalyst.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvid.catalog import RID, Catalog, Field, Table, vector_column
from korvid.errors import SQLExecutionError, SQLSemanticError
from korvid.operators import spatial, vectors
from korvid.operators import text as text_ops
from korvid.sql import ast as a

NUMBERS = ("INT", "FLOAT")
SCORE, SIMILARITY = "_score", "_similarity"


@dataclass
class Node:
    """A step of the logical plan, for EXPLAIN."""

    label: str
    details: dict[str, str] = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)


@dataclass
class Bound:
    """What a query comes to: its rows, their labels and the plan."""

    df: DataFrame
    labels: list[str]
    node: Node
    kinds: list[str]


# -- text of expressions --------------------------------------------------------------------------


def show(e: Any) -> str:
    """SQL text of an expression."""
    if isinstance(e, a.Literal):
        if isinstance(e.value, str):
            return "'" + e.value.replace("'", "''") + "'"
        return {None: "NULL", True: "TRUE", False: "FALSE"}[e.value] if e.value is None or isinstance(e.value, bool) else str(e.value)
    if isinstance(e, a.Point):
        return f"POINT({e.lat:g}, {e.lon:g})"
    if isinstance(e, a.Polygon):
        return "POLYGON(" + ", ".join(f"({x:g}, {y:g})" for x, y in e.rings[0]) + ")"
    if isinstance(e, a.Ref):
        return f"{e.table}.{e.column}" if e.table else e.column
    if isinstance(e, a.Star):
        return f"{e.table}.*" if e.table else "*"
    if isinstance(e, a.Unary):
        return f"NOT ({show(e.arg)})" if e.op == "NOT" else f"{e.op}{show(e.arg)}"
    if isinstance(e, a.Binary):
        return f"({show(e.left)} {e.op} {show(e.right)})"
    no = "NOT " if getattr(e, "negated", False) else ""
    if isinstance(e, a.IsNull):
        return f"({show(e.arg)} IS {no}NULL)"
    if isinstance(e, a.Between):
        return f"({show(e.arg)} {no}BETWEEN {show(e.low)} AND {show(e.high)})"
    if isinstance(e, a.InList):
        return f"({show(e.arg)} {no}IN ({', '.join(map(show, e.items))}))"
    if isinstance(e, a.Like):
        return f"({show(e.arg)} {no}LIKE {show(e.pattern)})"
    if isinstance(e, a.Aggregate):
        inner = "*" if e.arg is None else ("distinct " if e.distinct else "") + show(e.arg)
        return f"{e.name.lower()}({inner})"
    if isinstance(e, a.Distance):
        return f"distancia({show(e.left)}, {show(e.right)}" + (f", '{e.metric.lower()}')" if e.metric else ")")
    if isinstance(e, a.Within):
        return f"within({show(e.point)}, {show(e.polygon)})"
    if isinstance(e, a.Match):
        return f"match({show(e.column)}, '{e.query}') using {e.ranking}"
    if isinstance(e, a.SimilarTo):
        return f"similar_to({show(e.column) + ', ' if e.column else ''}'{e.path}', k={e.k}) using {e.method}"
    return "score()" if isinstance(e, a.Score) else "similarity_score()"


def children(e: Any) -> list[Any]:
    if isinstance(e, a.InList):
        return [e.arg, *e.items]
    if not dataclasses.is_dataclass(e):
        return []
    return [x for f in dataclasses.fields(e) if dataclasses.is_dataclass(x := getattr(e, f.name))]


def find(e: Any, kind) -> list[Any]:
    if isinstance(e, kind):
        return [e]
    return [x for c in children(e) for x in find(c, kind)]


def conjuncts(e: Any) -> list[Any]:
    if e is None:
        return []
    if isinstance(e, a.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def together(parts: list[Any]) -> Any:
    out = None
    for p in parts:
        out = p if out is None else a.Binary("AND", out, p)
    return out


def mapped(e: Any, change: Callable[[Any], Any]) -> Any:
    """The tree with change() applied from the top; where it returns something else, that stands."""
    new = change(e)
    if new is not e:
        return new
    if isinstance(e, a.InList):
        return dataclasses.replace(e, arg=mapped(e.arg, change), items=tuple(mapped(x, change) for x in e.items))
    if not dataclasses.is_dataclass(e):
        return e
    return dataclasses.replace(e, **{f.name: mapped(x, change) for f in dataclasses.fields(e) if dataclasses.is_dataclass(x := getattr(e, f.name))})


# -- scopes ---------------------------------------------------------------------------------------


@dataclass
class Source:
    alias: str
    table: Table


def slot(alias: str, column: str) -> str:
    """A column's name inside the plan."""
    return f"{alias}|{column}"


def at(name: str) -> Column:
    return F.col(f"`{name}`")


class Scope:
    def __init__(self, sources: list[Source]):
        self.sources = sources

    def resolve(self, ref: a.Ref) -> tuple[str, Field]:
        found = [(s.alias, f) for s in self.sources if ref.table in (None, s.alias) and (f := s.table.field(ref.column))]
        if not found:
            raise SQLSemanticError(f"column {show(ref)} does not exist")
        if len(found) > 1:
            raise SQLSemanticError(f"column {show(ref)} is ambiguous")
        return found[0]

    def qualify(self, e: Any) -> Any:
        return mapped(e, lambda x: a.Ref(x.column, self.resolve(x)[0]) if isinstance(x, a.Ref) else x)


# -- expressions ----------------------------------------------------------------------------------


def remainder(x: Column, y: Column) -> Column:
    """The remainder with the divisor's sign."""
    r = x % y
    return F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r + 0)  # no negative zero


class Expressions:
    """Turns qualified trees into typed columns. held: trees that are columns already (after aggregation)."""

    def __init__(self, scope: Scope, held: dict[Any, tuple[Column, str]] | None = None, scores: tuple[str, ...] = ()):
        self.scope, self.held, self.scores = scope, held, scores

    def condition(self, e: Any) -> Column:
        column, kind = self.of(e)
        if kind not in ("BOOL", "NULL"):
            raise SQLExecutionError(f"{show(e)} is not a condition")
        return F.lit(None).cast("boolean") if kind == "NULL" else column

    def of(self, e: Any) -> tuple[Column, str]:
        if self.held is not None and e in self.held:
            return self.held[e]
        if isinstance(e, a.Literal):
            v = e.value
            kind = "NULL" if v is None else "BOOL" if isinstance(v, bool) else "INT" if isinstance(v, int) else "FLOAT" if isinstance(v, float) else "STR"
            return F.lit(v), kind
        if isinstance(e, a.Point):
            return spatial.point(e.lat, e.lon), "POINT"
        if isinstance(e, a.Polygon):
            raise SQLSemanticError("a polygon stands in WITHIN only")
        if isinstance(e, a.Star):
            raise SQLSemanticError("* stands in COUNT or alone in the selection only")
        if isinstance(e, a.Ref):
            alias, f = self.scope.resolve(e)
            if self.held is not None:
                raise SQLSemanticError(f"column {show(e)} is outside GROUP BY")
            if f.type == "VECTOR":
                return at(slot(alias, f.name)), "VECTOR"
            return at(slot(alias, f.name)), f.kind
        if isinstance(e, a.Aggregate):
            raise SQLSemanticError("an aggregate can't stand here")
        if isinstance(e, a.Unary):
            if e.op == "NOT":
                return ~self.condition(e.arg), "BOOL"
            column, kind = self.number(e.arg)
            return (-column if e.op == "-" else column), kind
        if isinstance(e, a.Binary):
            return self.binary(e)
        if isinstance(e, a.IsNull):
            column, kind = self.of(e.arg)
            found = F.lit(kind == "NULL") if kind == "NULL" else column.isNull()
            return (~found if e.negated else found), "BOOL"
        if isinstance(e, a.Between):
            found = self.compare(e.arg, ">=", e.low) & self.compare(e.arg, "<=", e.high)
            return (~found if e.negated else found), "BOOL"
        if isinstance(e, a.InList):
            found = F.lit(False)
            for item in e.items:
                found = found | self.compare(e.arg, "=", item)
            return (~found if e.negated else found), "BOOL"
        if isinstance(e, a.Like):
            (x, k1), (y, k2) = self.of(e.arg), self.of(e.pattern)
            if {k1, k2} - {"STR", "NULL"}:
                raise SQLExecutionError("LIKE needs texts")
            if "NULL" in (k1, k2):
                return F.lit(None).cast("boolean"), "BOOL"
            # The dialect has no escape character: one that no pattern holds stands in for it.
            found = F.like(x, y, F.lit("\u0001"))
            return (~found if e.negated else found), "BOOL"
        if isinstance(e, a.Distance):
            (x, k1), (y, k2) = self.of(e.left), self.of(e.right)
            if k1 != "POINT" or k2 != "POINT":
                raise SQLSemanticError("DISTANCIA needs two points")
            return spatial.distance(x, y, e.metric or "HAVERSINE"), "FLOAT"
        if isinstance(e, a.Within):
            x, kind = self.of(e.point)
            if kind != "POINT" or not isinstance(e.polygon, a.Polygon):
                raise SQLSemanticError("WITHIN needs a point and a polygon")
            return spatial.within(x, e.polygon.rings), "BOOL"
        if isinstance(e, a.Score):
            if SCORE not in self.scores:
                raise SQLSemanticError("SCORE() needs MATCH and no aggregation")
            return at(SCORE), "FLOAT"
        if isinstance(e, a.SimilarityScore):
            if SIMILARITY not in self.scores:
                raise SQLSemanticError("SIMILARITY_SCORE() needs SIMILAR_TO and no aggregation")
            return at(SIMILARITY), "FLOAT"
        if isinstance(e, (a.Match, a.SimilarTo)):
            raise SQLSemanticError(f"{show(e)} stands once, as a condition of its own in WHERE")
        raise SQLSemanticError(f"can't use {show(e)} here")

    def number(self, e: Any) -> tuple[Column, str]:
        column, kind = self.of(e)
        if kind == "NULL":
            return F.lit(None).cast("double"), "FLOAT"
        if kind not in NUMBERS:
            raise SQLExecutionError(f"{show(e)} is not a number")
        return column, kind

    def binary(self, e: a.Binary) -> tuple[Column, str]:
        if e.op in ("AND", "OR"):
            x, y = self.condition(e.left), self.condition(e.right)
            return (x & y if e.op == "AND" else x | y), "BOOL"
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(e.left, e.op, e.right), "BOOL"
        (x, k1), (y, k2) = self.number(e.left), self.number(e.right)
        kind = "INT" if k1 == k2 == "INT" else "FLOAT"
        if e.op == "/":
            return x.cast("double") / y.cast("double"), "FLOAT"
        if kind == "INT":
            x, y = x.cast("long"), y.cast("long")
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: remainder(x, y)}[e.op](), kind

    def compare(self, left: Any, op: str, right: Any) -> Column:
        (x, k1), (y, k2) = self.of(left), self.of(right)
        if "NULL" in (k1, k2):
            return F.lit(None).cast("boolean")
        if {k1, k2} == {"TIME", "STR"}:
            x, y = (x, y.cast("timestamp_ntz")) if k1 == "TIME" else (x.cast("timestamp_ntz"), y)
        elif k1 != k2 and not (k1 in NUMBERS and k2 in NUMBERS):
            if op not in ("=", "!="):
                raise SQLExecutionError(f"{show(left)} and {show(right)} have no order")
            return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(op == "!="))
        found = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        box = self.circle(left, op, right)
        return found if box is None else box & found

    def circle(self, left: Any, op: str, right: Any) -> Column | None:
        """For a distance to a fixed point below a number, the box that the scan can use."""
        if op in (">", ">="):
            left, right, op = right, left, {">": "<", ">=": "<="}[op]
        if op not in ("<", "<=") or not isinstance(left, a.Distance) or not isinstance(right, a.Literal) or not isinstance(right.value, (int, float)) or right.value < 0:
            return None
        sides = [(left.left, left.right), (left.right, left.left)]
        for column, centre in sides:
            if isinstance(column, a.Ref) and isinstance(centre, a.Point):
                return spatial.in_box(self.of(column)[0], spatial.bounding_box(centre.lat, centre.lon, float(right.value), left.metric or "HAVERSINE"))
        return None


def aggregate(e: a.Aggregate, x: Column | None, kind: str) -> tuple[Column, str]:
    if e.arg is None:
        return F.count(F.lit(1)), "INT"
    if e.name == "COUNT":
        return (F.count_distinct(x) if e.distinct else F.count(x)), "INT"
    if e.name in ("SUM", "AVG"):
        if kind not in (*NUMBERS, "NULL"):
            raise SQLExecutionError(f"{e.name} needs numbers")
        if kind == "NULL":
            x = x.cast("double")
        if e.name == "SUM":
            return (F.sum_distinct(x) if e.distinct else F.sum(x)), kind if kind != "NULL" else "FLOAT"
        if e.distinct:
            return F.sum_distinct(x).cast("double") / F.count_distinct(x), "FLOAT"
        return F.avg(x), "FLOAT"
    if kind in ("VECTOR", "BOOL"):
        raise SQLExecutionError(f"{e.name} needs values with an order")
    return (F.min(x) if e.name == "MIN" else F.max(x)), kind


# -- queries --------------------------------------------------------------------------------------


class Lowering:
    """text_index and vector_search give the derived structures that the session keeps."""

    def __init__(self, catalog: Catalog, text_index, vector_search):
        self.catalog, self.text_index, self.vector_search = catalog, text_index, vector_search

    def source(self, ref: a.TableRef) -> tuple[Source, DataFrame, Node]:
        table = self.catalog.get(ref.name)
        df = self.catalog.frame(ref.name)
        df = df.select(*[at(c).alias(slot(ref.alias, c)) for c in df.columns])
        return Source(ref.alias, table), df, Node(f"Seq Scan on {ref.name}" + (f" {ref.alias}" if ref.alias != ref.name else ""))

    def select(self, q: a.Select) -> Bound:
        source, df, node = self.source(q.table)
        scope = Scope([source])
        for join in q.joins:
            df, node = self.join(scope, df, node, join)
        whole = [q.where, *q.group_by, q.having, *(i.expr for i in q.items), *(o.expr for o in q.order_by)]
        matches, similars = ([x for e in whole for x in find(e, kind)] for kind in (a.Match, a.SimilarTo))
        if q.where is not None and find(q.where, a.Aggregate):
            raise SQLSemanticError("an aggregate can't stand in WHERE")
        if any(find(e, a.Aggregate) for e in q.group_by):
            raise SQLSemanticError("an aggregate can't stand in GROUP BY")
        parts = conjuncts(q.where)
        scores: tuple[str, ...] = ()
        if matches and similars:
            raise SQLSemanticError("MATCH and SIMILAR_TO can't stand together")
        if matches:
            df, node, parts = self.match(scope, df, node, parts, matches, q)
            scores = (SCORE,)
        if similars:
            df, node, parts = self.similar(scope, df, node, parts, similars, q)
            scores = (SIMILARITY,)
        rows = Expressions(scope, scores=scores)
        where = together([scope.qualify(p) for p in parts])
        if where is not None:
            df = df.where(rows.condition(where))
            node = Node("Filter", {"Filter": show(where)}, [node])
        return self.output(q, scope, rows, df, node, scores)

    def join(self, scope: Scope, df: DataFrame, node: Node, join: a.Join) -> tuple[DataFrame, Node]:
        if any(s.alias == join.table.alias for s in scope.sources):
            raise SQLSemanticError(f"alias {join.table.alias} is repeated")
        left = list(scope.sources)
        source, other, child = self.source(join.table)
        scope.sources.append(source)
        on = scope.qualify(join.on)
        if find(on, a.Aggregate):
            raise SQLSemanticError("an aggregate can't stand in ON")

        def crosses(e: Any) -> bool:
            if not (isinstance(e, a.Binary) and e.op == "=" and isinstance(e.left, a.Ref) and isinstance(e.right, a.Ref)):
                return False
            sides = [any(s.alias == r.table for s in left) for r in (e.left, e.right)]
            return sides[0] != sides[1]

        if not any(map(crosses, conjuncts(on))):
            raise SQLSemanticError("a JOIN needs an equality between columns of both sides")
        keys = together([c for c in conjuncts(on) if crosses(c)])
        details = {"Hash Cond": show(keys)}
        rest = together([c for c in conjuncts(on) if not crosses(c)])
        if rest is not None:
            details["Join Filter"] = show(rest)
        rows = Expressions(scope)
        near = next((n for c in conjuncts(on) if (n := self._bounded(c, left, scope))), None)
        if near is None:
            made = df.join(other, rows.condition(on), "inner")
        else:
            a_point, b_point, radius, metric = near
            made = spatial.within_distance(df, other, rows.of(a_point)[0], rows.of(b_point)[0], radius, metric, rows.condition(on))
        return made, Node("Hash Join", details, [node, Node("Hash", {}, [child])])

    @staticmethod
    def _bounded(e: Any, left: list[Source], scope: Scope) -> tuple[a.Ref, a.Ref, float, str] | None:
        """(point of the sources before, point of the new one, radius, metric) if e is their distance below a number."""
        if not isinstance(e, a.Binary):
            return None
        d, limit = (e.left, e.right) if e.op in ("<", "<=") else (e.right, e.left) if e.op in (">", ">=") else (None, None)
        if not (isinstance(d, a.Distance) and isinstance(limit, a.Literal) and type(limit.value) in (int, float) and limit.value >= 0):
            return None
        if not all(isinstance(r, a.Ref) and scope.resolve(r)[1].kind == "POINT" for r in (d.left, d.right)):
            return None
        sides = [any(s.alias == r.table for s in left) for r in (d.left, d.right)]
        if sides[0] == sides[1]:
            return None
        before, new = (d.left, d.right) if sides[0] else (d.right, d.left)
        return before, new, float(limit.value), d.metric or "HAVERSINE"

    def _alone(self, scope: Scope, parts: list[Any], found: list[Any], what: str) -> None:
        if len(scope.sources) > 1:
            raise SQLSemanticError(f"{what} needs a query over one table")
        if len(found) > 1 or not any(p is found[0] for p in parts):
            raise SQLSemanticError(f"{what} stands once, as a condition of its own in WHERE")

    def match(self, scope, df, node, parts, found, q):
        self._alone(scope, parts, found, "MATCH")
        m, source = found[0], scope.sources[0]
        _, f = scope.resolve(m.column)
        if f.type not in ("TEXT", "VARCHAR"):
            raise SQLSemanticError("MATCH needs a text column")
        index = self.text_index(source.table, f.name)
        scored = text_ops.RANKINGS[m.ranking](index, m.query).select(F.col("doc_id").alias("_doc"), F.col("score").alias(SCORE))
        df = df.join(scored, at(slot(source.alias, RID)) == F.col("_doc")).drop("_doc")
        node = Node(f"Text Search on {source.table.name}", {"Text Cond": show(m), "Ranking": m.ranking}, [node])
        return df, node, [p for p in parts if p is not m]

    def similar(self, scope, df, node, parts, found, q):
        self._alone(scope, parts, found, "SIMILAR_TO")
        s, source = found[0], scope.sources[0]
        if s.column is not None:
            scope.resolve(s.column)
        nearest, details = self.vector_search(source.table, s)
        nearest = nearest.select(F.col(RID).alias("_near"), F.col(SIMILARITY))
        # The k nearest of the whole table come first, the other conditions filter them.
        df = df.join(nearest, at(slot(source.alias, RID)) == F.col("_near")).drop("_near")
        node = Node(f"Vector Search on {source.table.name}", details, [node])
        return df, node, [p for p in parts if p is not s]

    def output(self, q: a.Select, scope: Scope, rows: Expressions, df: DataFrame, node: Node, scores) -> Bound:
        items: list[tuple[Any, str]] = []
        many = len(scope.sources) > 1
        for item in q.items:
            if isinstance(item.expr, a.Star):
                own = [s for s in scope.sources if item.expr.table in (None, s.alias)]
                if not own:
                    raise SQLSemanticError(f"alias {item.expr.table} does not exist")
                items += [(a.Ref(f.name, s.alias), f"{s.alias}.{f.name}" if many else f.name) for s in own for f in s.table.fields]
            else:
                items.append((scope.qualify(item.expr), item.alias or show(item.expr)))
        labels = [label for _, label in items]
        twice = next((x for x in labels if labels.count(x) > 1), None)
        if twice is not None:
            raise SQLSemanticError(f"output column {twice} is repeated")
        group = [scope.qualify(e) for e in q.group_by]
        having = scope.qualify(q.having) if q.having is not None else None
        order: list[tuple[Any, a.OrderItem]] = []
        aliases = {i.alias: e for i, (e, _) in zip(q.items, items)} if not any(isinstance(i.expr, a.Star) for i in q.items) else {i.alias: scope.qualify(i.expr) for i in q.items if i.alias}
        for o in q.order_by:
            e = o.expr
            if isinstance(e, a.Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
                if not 1 <= e.value <= len(items):
                    raise SQLSemanticError(f"ORDER BY position {e.value} is out of range")
                order.append((items[e.value - 1][0], o))
            elif isinstance(e, a.Ref) and e.table is None and e.column in aliases and aliases[e.column] is not None:
                order.append((aliases[e.column], o))
            else:
                order.append((scope.qualify(e), o))

        exprs = [e for e, _ in items] + [e for e, _ in order] + ([having] if having is not None else [])
        calls = list(dict.fromkeys(x for e in exprs for x in find(e, a.Aggregate)))
        grouped = bool(group or calls or having is not None)
        out = rows
        if grouped:
            if scores and any(find(e, (a.Score, a.SimilarityScore)) for e in exprs):
                raise SQLSemanticError("scores can't be used with aggregation")
            df, out = self.aggregated(scope, rows, df, group, calls)
            label = "HashAggregate" if group else "Aggregate"
            node = Node(label, {"Group Key": ", ".join(map(show, group))} if group else {}, [node])
            if having is not None:
                df = df.where(out.condition(having))
                node = Node("Filter", {"Filter": show(having)}, [node])
        columns = [(out.of(e), label) for e, label in items]
        keys = [(out.of(e)[0], o) for e, o in order]
        if q.distinct:
            chosen = [e for e, _ in items]
            if any(e not in chosen for e, _ in order):
                raise SQLSemanticError("with DISTINCT, ORDER BY uses selected expressions only")
            df = df.select(*[c.alias(f"_p{i}") for i, ((c, _), _) in enumerate(columns)]).distinct()
            node = Node("Unique", {}, [node])
            keys = [(at(f"_p{chosen.index(e)}"), o) for e, o in order]
            final = [at(f"_p{i}").alias(label) for i, (_, label) in enumerate(columns)]
        else:
            final = [c.alias(label) for (c, _), label in columns]
        if keys:
            df = df.orderBy(*[_ordered(c, o) for c, o in keys])
            node = Node("Sort", {"Sort Key": ", ".join(show(e) + (" DESC" if o.descending else "") for e, o in order)}, [node])
        elif scores and not grouped and not q.distinct:
            # A ranking comes best first, also without ORDER BY.
            df = df.orderBy(F.desc(scores[0]), at(slot(scope.sources[0].alias, RID)))
            node = Node("Sort", {"Sort Key": f"{scores[0][1:]} DESC"}, [node])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        if q.offset or q.limit is not None:
            node = Node("Limit", {k: str(v) for k, v in (("Rows", q.limit), ("Offset", q.offset)) if v is not None}, [node])
        return Bound(df.select(*final), labels, node, [kind for (_, kind), _ in columns])

    def aggregated(self, scope, rows, df, group, calls):
        held: dict[Any, tuple[Column, str]] = {}
        keys, made = [], []
        for i, e in enumerate(group):
            column, kind = rows.of(e)
            keys.append(column.alias(f"_g{i}"))
            held[e] = (at(f"_g{i}"), kind)
        for i, call in enumerate(calls):
            x, kind = (None, "INT") if call.arg is None else rows.of(call.arg)
            column, kind = aggregate(call, x, kind)
            made.append(column.alias(f"_a{i}"))
            held[call] = (at(f"_a{i}"), kind)
        # A literal key is a constant, not a position: keys become columns before they group.
        df = df.select("*", *keys) if keys else df
        names = [at(f"_g{i}") for i in range(len(keys))]
        if made:
            df = df.groupBy(*names).agg(*made) if names else df.agg(*made)
        else:
            df = df.select(*names).distinct() if names else df.agg(F.lit(1).alias("_none"))
        return df, Expressions(scope, held)


def _ordered(c: Column, o: a.OrderItem) -> Column:
    if o.descending:
        return c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if o.nulls_first else c.asc_nulls_last()


__all__ = ["Bound", "Expressions", "Lowering", "Node", "Scope", "Source", "at", "show", "slot", "vector_column", "vectors"]
