"""A syntax tree as a DataFrame: matches are joins, WITH is a new frame, EXISTS a semi join."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.common import cut, lookup_join
from codeloom.plans.pattern import syntax as S
from codeloom.plans.pattern.errors import PatternError
from codeloom.plans.pattern.graph_views import EDGE_COLUMNS, LABELS, NODE_PROPERTIES, STORED_TYPES, SYNTHETIC, PatternGraph

MAX_REGEX = 500
_SEP = "·"
_LABELS = {**{v.lower(): v for v in LABELS.values()}, **{v.lower(): v for v in SYNTHETIC}}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _labels(names: tuple[str, ...]) -> list[str] | None:
    out = []
    for n in names:
        if n.lower() not in _LABELS:
            raise PatternError(f"unknown label {n}", "semantic")
        out.append(_LABELS[n.lower()])
    return out or None


def _types(names: tuple[str, ...]) -> list[str] | None:
    out = []
    for n in names:
        if n.upper() not in (*STORED_TYPES, "CONTAINS"):
            raise PatternError(f"unknown edge type {n}", "semantic")
        out.append(n.upper())
    return out or None


def _turned(links: DataFrame, a: str, b: str) -> DataFrame:
    """The links with their ends exchanged."""
    swap = {a: b, b: a}
    return links.select(*[F.col(f"`{c}`").alias(swap.get(c, c)) for c in links.columns])


@dataclass
class Frame:
    """A DataFrame and what its columns stand for: variables by kind (node, edge, value)."""

    df: DataFrame | None = None
    scope: dict[str, str] = field(default_factory=dict)
    hidden: int = 0


class Builder:
    def __init__(self, graph: PatternGraph) -> None:
        self.graph = graph
        self.frame = Frame()
        self.fresh = 0
        self.labels_of: dict[str, list[str] | None] = {}
        self.inside = 0  # depth of EXISTS: there, typed edges are read as stored, without unresolved targets

    # queries

    def build(self, query: S.Query) -> DataFrame:
        parts, last = [], None
        for clauses in query.branches:
            self.frame, self.labels_of = Frame(), {}
            for clause in clauses:
                self.clause(clause)
            last = clauses[-1]
            parts.append(self.frame.df)
        out = parts[0]
        if len(parts) > 1:
            for part, keep in zip(parts[1:], query.keep_duplicates, strict=True):
                if len(part.columns) != len(out.columns):
                    raise PatternError("the parts of a union have different numbers of columns", "semantic")
                out = out.union(part.toDF(*out.columns))
                if not keep:
                    out = out.distinct()
            out = self.ordered_union(out, last)
        return out

    def ordered_union(self, df: DataFrame, last: S.Projection) -> DataFrame:
        order = []
        for expression, descending in last.order:
            if not isinstance(expression, S.Variable) or expression.name not in df.columns:
                raise PatternError("a union is ordered by its columns", "semantic")
            order.append(F.col(f"`{expression.name}`").desc() if descending else F.col(f"`{expression.name}`").asc())
        df = df.orderBy(*(order or [F.col(f"`{c}`") for c in df.columns]))
        return df.offset(last.skip or 0).limit(last.limit) if last.limit is not None else df.offset(last.skip) if last.skip else df

    def clause(self, clause: Any) -> None:
        if isinstance(clause, S.Match):
            for path in clause.paths:
                self.match(path, clause.optional)
            if clause.where is not None:
                self.where(clause.where)
        elif isinstance(clause, S.Unwind):
            self.unwind(clause)
        else:
            self.project(clause)

    # patterns

    def new_name(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    def node_frame(self, variable: str, pattern: S.NodePattern) -> DataFrame:
        nodes = self.graph.nodes(_labels(pattern.labels))
        for key, value in pattern.properties:
            if key not in NODE_PROPERTIES:
                raise PatternError(f"unknown node property {key}", "semantic")
            nodes = nodes.where(F.col(key) == self.constant(value))
        return nodes.select(*[F.col(p).alias(variable + _SEP + p) for p in NODE_PROPERTIES])

    def constant(self, expression: Any) -> Column:
        if isinstance(expression, S.Literal):
            return F.lit(int(expression.value) if isinstance(expression.value, bool) else expression.value)
        raise PatternError("the values of a pattern are literals", "unsupported")

    def bind(self, variable: str, kind: str) -> None:
        self.frame.scope[variable] = kind

    def start(self, pattern: S.NodePattern, optional: bool) -> str:
        variable = pattern.variable or self.new_name()
        if variable in self.frame.scope:
            if self.frame.scope[variable] != "node":
                raise PatternError(f"{variable} is not a node", "semantic")
            self.constrain(variable, pattern, optional)
            return variable
        nodes = self.node_frame(variable, pattern)
        if self.frame.df is None:
            self.frame.df = nodes
        elif optional:
            self.frame.df = self.frame.df.join(nodes, F.lit(True), "left")
        else:
            self.frame.df = self.frame.df.crossJoin(nodes)  # a comma pattern without a shared variable is a product by definition
        self.bind(variable, "node")
        self.labels_of[variable] = _labels(pattern.labels)
        return variable

    def constrain(self, variable: str, pattern: S.NodePattern, optional: bool) -> None:
        """What a pattern demands of a bound node; OPTIONAL MATCH demands it of the edge only."""
        if optional:
            return
        condition = F.lit(True)
        labels = _labels(pattern.labels)
        if labels:
            condition &= F.col(variable + _SEP + "label").isin(*labels)
        for key, value in pattern.properties:
            condition &= F.col(variable + _SEP + key) == self.constant(value)
        if labels or pattern.properties:
            self.frame.df = self.frame.df.where(condition)

    def match(self, path: S.Path, optional: bool) -> None:
        nodes, edges = path.nodes, path.edges
        bound = [k for k, n in enumerate(nodes) if n.variable and n.variable in self.frame.scope]
        if self.frame.df is not None and bound and bound[0] > 0:
            # begin at a node that is bound: the part before it, mirrored, and the part after it mean the same
            at = bound[0]
            flip = {"out": "in", "in": "out", "both": "both"}
            before = tuple(S.EdgePattern(e.variable, e.types, e.properties, flip[e.direction], e.hops) for e in edges[:at][::-1])
            self.follow(nodes[: at + 1][::-1], before, optional)
            nodes, edges = nodes[at:], edges[at:]
        self.follow(nodes, edges, optional)

    def follow(self, nodes: Sequence[S.NodePattern], edges: Sequence[S.EdgePattern], optional: bool) -> None:
        here = self.start(nodes[0], optional)
        for edge, node in zip(edges, nodes[1:], strict=True):
            here = self.hop(here, edge, node, optional)

    def hop(self, here: str, edge: S.EdgePattern, node: S.NodePattern, optional: bool) -> str:
        if edge.hops:
            return self.walk(here, edge, node)
        there = node.variable or self.new_name()
        name = edge.variable or self.new_name()
        if edge.variable and edge.variable in self.frame.scope:
            raise PatternError(f"{edge.variable} is bound twice", "semantic")
        mine, theirs = self.labels_of.get(here), _labels(node.labels) or self.labels_of.get(node.variable or "")
        named = any("Unresolved" in (x or ()) for x in (mine, theirs))
        unresolved = named or (theirs is None and not (self.inside and edge.types))
        files = (theirs is None or "File" in theirs) and (mine is None or "File" in mine)
        links = self.graph.links(_types(edge.types), unresolved, files)
        for key, value in edge.properties:
            column = F.col(key) if key in EDGE_COLUMNS or key == "line" else F.col("properties")[key]
            links = links.where(column == self.constant(value))
        columns = [*EDGE_COLUMNS, "line", "properties"]
        a, b = name + _SEP + "from", name + _SEP + "to"
        out = links.select(*[F.col(c).alias(name + _SEP + c) for c in columns], F.col("source").alias(a), F.col("target").alias(b))
        if edge.direction == "in":
            out = _turned(out, a, b)
        elif edge.direction == "both":
            out = out.unionByName(_turned(out.where(F.col(a) != F.col(b)), a, b))  # two equi-joins instead of one join on either end
        on = F.col(here + _SEP + "id") == F.col(a)
        how = "left" if optional else "inner"
        if there in self.frame.scope:
            if self.frame.scope[there] != "node":
                raise PatternError(f"{there} is not a node", "semantic")
            self.frame.df = self.frame.df.join(out, on & (F.col(there + _SEP + "id") == F.col(b)), how)
            self.constrain(there, node, optional)
        else:
            self.frame.df = self.frame.df.join(out, on, how)
            target = self.node_frame(there, node)
            # nodes are one per id; those that very many edges lead to meet them where they lie
            self.frame.df = lookup_join(self.frame.df, target, b, there + _SEP + "id", list(self.graph.hot), how)
            self.bind(there, "node")
            self.labels_of[there] = _labels(node.labels)
        self.frame.df = self.frame.df.drop(a, b)
        if edge.variable:
            self.bind(name, "edge")
        else:
            self.frame.df = self.frame.df.drop(*[name + _SEP + c for c in columns])
        return there

    def walk(self, here: str, edge: S.EdgePattern, node: S.NodePattern) -> str:
        """Pairs of nodes by number of steps: each pair counts once per number, circles are allowed."""
        if edge.variable or edge.properties:
            raise PatternError("a variable-length step has no variable and no properties", "unsupported")
        low, high = edge.hops or (1, 1)
        steps = self.graph.steps(_types(edge.types))
        if edge.direction == "in":
            steps = steps.select(F.col("target").alias("source"), F.col("source").alias("target"))
        elif edge.direction == "both":
            steps = steps.unionByName(steps.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
        steps = cut(steps)
        first = cut(self.frame.df.select(F.col(here + _SEP + "id").alias("s")).distinct())
        level = first.select("s", F.col("s").alias("at"))
        found = None
        for hop in range(1, high + 1):
            level = cut(level.join(steps, F.col("at") == F.col("source")).select("s", F.col("target").alias("at")).distinct())
            if hop >= low:
                found = level if found is None else found.unionByName(level)
        there = node.variable or self.new_name()
        pairs = found.select(F.col("s").alias("_s"), F.col("at").alias("_t"))
        on = F.col(here + _SEP + "id") == F.col("_s")
        if there in self.frame.scope:
            self.frame.df = self.frame.df.join(pairs, on & (F.col(there + _SEP + "id") == F.col("_t")))
            self.constrain(there, node, False)
        else:
            self.frame.df = self.frame.df.join(pairs, on).join(self.node_frame(there, node), F.col("_t") == F.col(there + _SEP + "id"))
            self.bind(there, "node")
            self.labels_of[there] = _labels(node.labels)
        self.frame.df = self.frame.df.drop("_s", "_t")
        return there

    # other clauses

    def where(self, condition: Any) -> None:
        if S.has_aggregate(condition):
            raise PatternError("aggregates belong into WITH or RETURN", "semantic")
        if isinstance(condition, S.Binary) and condition.op == "AND":
            self.where(condition.left)
            self.where(condition.right)
        elif isinstance(condition, S.Exists):
            self.semi(condition, "left_semi")
        elif isinstance(condition, S.Unary) and condition.op == "NOT" and isinstance(condition.operand, S.Exists):
            self.semi(condition.operand, "left_anti")
        else:
            keep = self.frame.df
            test = self.truth(condition)
            self.frame.df = self.frame.df.where(test)
            self.drop_hidden(keep)

    def drop_hidden(self, before: DataFrame) -> None:
        flags = [c for c in self.frame.df.columns if c.startswith("_exists")]
        if flags:
            self.frame.df = self.frame.df.drop(*flags)

    def outer_columns(self, exists: S.Exists) -> list[str]:
        """Columns of the outer variables that an inner pattern or its condition names."""
        names = {n.variable for p in exists.paths for n in p.nodes if n.variable}
        stack = [exists.where] if exists.where is not None else []
        while stack:
            x = stack.pop()
            if isinstance(x, S.Variable):
                names.add(x.name)
            if isinstance(x, S.Exists):
                names |= {n.variable for p in x.paths for n in p.nodes if n.variable}
                stack += [x.where] if x.where is not None else []
            stack += S.children(x)
        out = []
        for name in sorted(n for n in names if n in self.frame.scope):
            if self.frame.scope[name] == "value":
                out.append(name)
            else:
                out += [c for c in self.frame.df.columns if c.startswith(name + _SEP)]
        return out

    def matched(self, exists: S.Exists) -> tuple[DataFrame, list[str]]:
        """The distinct outer keys for which the inner pattern has a match."""
        columns = self.outer_columns(exists)
        keys = [c for c in columns if not c.count(_SEP) or c.endswith(_SEP + "id")]
        outer, self.frame = self.frame, Frame(None, {})
        self.inside += 1
        try:
            if columns:
                scope = {c.split(_SEP)[0]: outer.scope[c.split(_SEP)[0]] for c in columns}
                self.frame = Frame(outer.df.select(*[F.col(f"`{c}`") for c in columns]).distinct(), dict(scope))
            for path in exists.paths:
                self.match(path, False)
            if exists.where is not None:
                self.where(exists.where)
            inner = self.frame.df
        finally:
            self.frame = outer
            self.inside -= 1
        return inner.select(*[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)], F.lit(1).alias("_hit")).distinct(), keys

    def semi(self, exists: S.Exists, how: str) -> None:
        inner, keys = self.matched(exists)
        on = F.lit(True)
        for n, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}"))
        self.frame.df = self.frame.df.join(inner, on, how)

    def exists_flag(self, exists: S.Exists) -> Column:
        inner, keys = self.matched(exists)
        self.frame.hidden += 1
        flag = f"_exists{self.frame.hidden}"
        on = F.lit(True)
        for n, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}"))
        joined = self.frame.df.join(inner, on, "left").withColumn(flag, F.col("_hit").isNotNull())
        self.frame.df = joined.drop("_hit", *[f"_k{n}" for n in range(len(keys))])
        return F.col(flag)

    def unwind(self, clause: S.Unwind) -> None:
        if self.frame.df is None:
            self.frame.df = self.graph.symbols.sparkSession.range(1).select(F.lit(1).alias("_one"))
        value = self.value(clause.expression)
        self.frame.df = self.frame.df.withColumn(clause.name, F.explode(value))
        self.bind(clause.name, "value")

    def project(self, clause: S.Projection) -> None:
        if self.frame.df is None:
            self.frame.df = self.graph.symbols.sparkSession.range(1).select(F.lit(1).alias("_one"))
        items = list(clause.items)
        if clause.star:
            items = [(S.Variable(v), v, v) for v in self.frame.scope if not v.startswith("_")] + items
        names: list[str] = []
        for expression, alias, text in items:
            if not clause.final and alias is None and not isinstance(expression, S.Variable):
                raise PatternError("WITH needs a name for each expression", "semantic")
            base = alias or (expression.name if isinstance(expression, S.Variable) else text)
            name, n = base, 2
            while name in names:
                name, n = f"{base}_{n}", n + 1
            names.append(name)
        keeps_node = lambda e: not clause.final and isinstance(e, S.Variable) and self.frame.scope.get(e.name) in ("node", "edge")
        plain: list[Column] = []
        aggregated: list[Column] = []
        scope: dict[str, str] = {}
        for (expression, _, _), name in zip(items, names, strict=True):
            if keeps_node(expression):
                prefix = expression.name + _SEP
                plain += [F.col(f"`{c}`").alias(name + _SEP + c[len(prefix) :]) for c in self.frame.df.columns if c.startswith(prefix)]
                scope[name] = self.frame.scope[expression.name]
                self.labels_of[name] = self.labels_of.get(expression.name)
            elif S.has_aggregate(expression):
                aggregated.append(self.shown(expression).alias(name))
                scope[name] = "value"
            else:
                plain.append(self.shown(expression).alias(name))
                scope[name] = "value"
        before = self.frame
        extra: list[tuple[str, Column]] = []
        if aggregated:
            grouped = before.df.groupBy(*plain).agg(*aggregated) if plain else before.df.agg(*aggregated)
            out = grouped
        else:
            order_only = [e for e, _ in clause.order if not self.is_output(e, names, items)]
            for n, e in enumerate(order_only):
                extra.append((f"_order{n}", self.shown(e).alias(f"_order{n}")))
            if extra and clause.distinct:
                raise PatternError("DISTINCT is ordered by its columns", "semantic")
            out = self.frame.df.select(*plain, *[c for _, c in extra])
        columns = [c for name in names for c in ([name] if name in out.columns else [x for x in out.columns if x.startswith(name + _SEP)])]
        out = out.select(*[F.col(f"`{c}`") for c in columns], *[F.col(n) for n, _ in extra])
        if clause.distinct:
            out = out.distinct()
        order, used = [], 0
        for expression, descending in clause.order:
            if self.is_output(expression, names, items):
                column = F.col(f"`{self.output_name(expression, names, items)}`")
            elif extra:
                column = F.col(f"_order{used}")
                used += 1
            else:
                raise PatternError("an aggregation is ordered by its columns", "semantic")
            order.append(column.desc() if descending else column.asc())
        if clause.final and not order:
            order = [F.col(f"`{c}`") for c in columns if not isinstance(out.schema[c].dataType, T.MapType)]
        if order and (clause.final or clause.skip or clause.limit is not None):
            out = out.orderBy(*order)
        if clause.skip:
            out = out.offset(clause.skip)
        if clause.limit is not None:
            out = out.limit(clause.limit)
        self.frame = Frame(out.drop(*[n for n, _ in extra]), scope)
        if clause.where is not None:
            self.where(clause.where)

    def is_output(self, expression: Any, names: list[str], items: list) -> bool:
        return self.output_name(expression, names, items) is not None

    def output_name(self, expression: Any, names: list[str], items: list) -> str | None:
        if isinstance(expression, S.Variable) and expression.name in names:
            return expression.name
        return next((n for (e, _, _), n in zip(items, names, strict=True) if e == expression and not (isinstance(e, S.Variable) and self.frame.scope.get(e.name) in ("node", "edge"))), None)

    # expressions

    def shown(self, expression: Any) -> Column:
        """A value that leaves the query: truth values are 1 and 0, whole nodes and edges JSON."""
        if isinstance(expression, S.Variable) and self.frame.scope.get(expression.name) in ("node", "edge"):
            return self.whole(expression.name)
        column = self.value(expression)
        return column.cast("int") if self.is_truth(expression) else column

    def whole(self, name: str) -> Column:
        keys = ["id", "label", "name", "kind", "fqn", "file_path", "line_start", "line_end"] if self.frame.scope[name] == "node" else ["id", "type", "source", "target", "resolved", "tier"]
        return F.when(F.col(f"`{name}{_SEP}id`").isNotNull(), F.to_json(F.struct(*[F.col(f"`{name}{_SEP}{k}`").alias(k) for k in keys])))

    def is_truth(self, e: Any) -> bool:
        if isinstance(e, S.Exists | S.LabelTest):
            return True
        if isinstance(e, S.Unary):
            return e.op in ("NOT", "ISNULL", "NOTNULL")
        return isinstance(e, S.Binary) and e.op in ("AND", "OR", "XOR", "=", "<>", "<", ">", "<=", ">=", "=~", "IN", "CONTAINS", "STARTS", "ENDS")

    def truth(self, e: Any) -> Column:
        column = self.value(e)
        return column if self.is_truth(e) else column.cast("int") != 0

    def kind_of(self, column: Column) -> T.DataType:
        return self.frame.df.select(column.alias("x")).schema["x"].dataType

    def value(self, e: Any) -> Column:
        if isinstance(e, S.Literal):
            return F.lit(int(e.value) if isinstance(e.value, bool) else e.value)
        if isinstance(e, S.Variable):
            kind = self.frame.scope.get(e.name)
            if kind is None:
                raise PatternError(f"unknown variable {e.name}", "semantic")
            return F.col(f"`{e.name}`") if kind == "value" else F.col(f"`{e.name}{_SEP}id`")
        if isinstance(e, S.Property):
            return self.property(e)
        if isinstance(e, S.LabelTest):
            return F.col(f"`{e.base.name}{_SEP}label`").isin(*(_labels(e.labels) or []))
        if isinstance(e, S.Exists):
            return self.exists_flag(e)
        if isinstance(e, S.Unary):
            return self.unary(e)
        if isinstance(e, S.Binary):
            return self.binary(e)
        if isinstance(e, S.ListValue):
            return F.array(*[self.value(x) for x in e.items])
        if isinstance(e, S.MapValue):
            return F.to_json(F.struct(*[self.value(v).alias(k) for k, v in e.entries]))
        if isinstance(e, S.Case):
            return self.case(e)
        if isinstance(e, S.Call):
            return self.call(e)
        raise PatternError("unsupported expression", "unsupported")

    def property(self, e: S.Property) -> Column:
        kind = self.frame.scope.get(e.base.name)
        if kind == "node":
            if e.key not in NODE_PROPERTIES:
                raise PatternError(f"unknown node property {e.key}", "semantic")
            return F.col(f"`{e.base.name}{_SEP}{e.key}`")
        if kind == "edge":
            if e.key in EDGE_COLUMNS or e.key == "line":
                return F.col(f"`{e.base.name}{_SEP}{e.key}`")
            return F.col(f"`{e.base.name}{_SEP}properties`")[e.key]
        raise PatternError(f"{e.base.name} has no properties", "semantic")

    def unary(self, e: S.Unary) -> Column:
        if e.op == "NOT":
            return ~self.truth(e.operand)
        column = self.value(e.operand)
        return {"-": lambda: -column, "ISNULL": column.isNull, "NOTNULL": column.isNotNull}[e.op]()

    def binary(self, e: S.Binary) -> Column:
        if e.op in ("AND", "OR", "XOR"):
            a, b = self.truth(e.left), self.truth(e.right)
            return {"AND": a & b, "OR": a | b, "XOR": (a & ~b) | (~a & b)}[e.op]
        if e.op == "IN" and isinstance(e.right, S.ListValue):
            return self.value(e.left).isin(*[self.value(x) for x in e.right.items]) if e.right.items else F.lit(False)
        a, b = self.value(e.left), self.value(e.right)
        if self.is_truth(e.left):
            a = a.cast("int")
        if self.is_truth(e.right):
            b = b.cast("int")
        if e.op == "IN":
            return F.array_contains(b, a)
        if e.op in ("=", "<>", "<", ">", "<=", ">="):
            return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e.op]
        if e.op == "CONTAINS":
            return F.contains(a, b)
        if e.op == "STARTS":
            return F.startswith(a, b)
        if e.op == "ENDS":
            return F.endswith(a, b)
        if e.op == "=~":
            if not isinstance(e.right, S.Literal) or not isinstance(e.right.value, str):
                raise PatternError("a pattern is a string", "semantic")
            if len(e.right.value) > MAX_REGEX:
                raise PatternError("the regular expression is too long", "semantic")
            try:
                re.compile(e.right.value)
            except re.error as x:
                raise PatternError(f"invalid regular expression: {x}", "semantic") from x
            return F.coalesce(a.rlike(rf"\A(?:{e.right.value})\z"), F.lit(False))
        if e.op == "+" and any(isinstance(self.kind_of(x), T.StringType) for x in (a, b)):
            return F.concat(a.cast("string"), b.cast("string"))
        whole = all(isinstance(self.kind_of(x), _INTEGERS) for x in (a, b))
        if e.op == "/":
            zero = b == 0
            return F.when(zero, None).otherwise(F.call_function("div", a, F.when(~zero, b)) if whole else a / F.when(~zero, b))
        if e.op == "%":
            return a % F.nullif(b, F.lit(0))
        return {"+": a + b, "-": a - b, "*": a * b}[e.op]

    def case(self, e: S.Case) -> Column:
        out: Column | None = None
        for condition, result in e.branches:
            test = self.truth(condition) if e.subject is None else self.value(e.subject) == self.value(condition)
            value = self.shown(result)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(self.shown(e.otherwise)) if e.otherwise is not None else out

    def call(self, e: S.Call) -> Column:
        name, args = e.name, e.args
        if name == "count":
            if e.star:
                return F.count(F.lit(1))
            column = self.value(args[0])
            return F.count_distinct(column) if e.distinct else F.count(column)
        if name in S.AGGREGATES:
            column = self.shown(args[0]) if name == "collect" else self.value(args[0])
            if name == "collect":
                # nulls are kept: they are collected inside of structs
                boxed = F.struct(column.alias("v"))
                rows = F.collect_set(boxed) if e.distinct else F.collect_list(boxed)
                return F.transform(F.array_sort(rows), lambda x: x["v"])
            if name == "sum":
                return F.sum_distinct(column) if e.distinct else F.sum(column)
            return {"avg": F.avg, "min": F.min, "max": F.max}[name](column)
        if name in ("labels", "type", "id"):
            if not args or not isinstance(args[0], S.Variable):
                raise PatternError(f"{name} takes a variable", "semantic")
            kind = self.frame.scope.get(args[0].name)
            wanted = {"labels": "node", "type": "edge"}.get(name)
            if kind is None or (wanted and kind != wanted) or kind == "value":
                raise PatternError(f"{name} does not fit {args[0].name}", "semantic")
            return F.col(f"`{args[0].name}{_SEP}{dict(labels='label', type='type', id='id')[name]}`")
        values = [self.value(a) for a in args]
        need = {"coalesce": (1, 99), "replace": (3, 3), "substring": (2, 3)}.get(name, (1, 1))
        if not need[0] <= len(values) <= need[1]:
            raise PatternError(f"{name} has the wrong number of arguments", "semantic")
        v = values[0]
        if name == "substring":
            start = values[1] + 1
            return F.substr(v, start, values[2]) if len(values) == 3 else F.substr(v, start)
        simple = {
            "coalesce": lambda: F.coalesce(*values), "tolower": lambda: F.lower(v), "toupper": lambda: F.upper(v), "trim": lambda: F.trim(v),
            "tostring": lambda: v.cast("string"), "size": lambda: F.char_length(v), "length": lambda: F.char_length(v),
            "replace": lambda: F.replace(v, values[1], values[2]), "basename": lambda: F.element_at(F.split(v, "/"), -1),
            "dirname": lambda: F.regexp_extract(v, r"^(.*)/[^/]*$", 1),
        }
        return simple[name]()


def build(text: str, graph: PatternGraph) -> DataFrame:
    """The DataFrame of a pattern query: ordered, without any cap of rows."""
    return Builder(graph).build(S.parse(text))
