"""The pattern language: tokens, a parser, and plans of joins over the graph's tables. What it cannot translate it rejects.

A query is a sequence of MATCH, OPTIONAL MATCH and WITH clauses and a RETURN, or a UNION of such. A clause's patterns become one relation: a node is
a struct column of its row, an edge one of its own, a path of variable length comes from ``traverse.trails``, so no edge
repeats in it. The relation joins what is bound already by the keys of the variables that both have: an inner join, for OPTIONAL MATCH a left
one, for a pattern as a condition a semi or anti join. Expressions become Spark SQL; parameters become literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import SymGraph
from .traverse import trails

#: Labels: table and key. Edge types: table, columns of the two ends, and the labels of these.
NODES = {"File": ("files", "path"), "Symbol": ("symbols", "id"), "Document": ("documents", "path"), "DocSection": ("sections", "id"), "Rule": ("rules", "id"), "ContractEntity": ("contract_entities", "id"), "ContractField": ("contract_fields", "id"), "StorageContainer": ("storage_containers", "id"), "StorageAttribute": ("storage_attributes", "id")}
EDGES = {
    "CALLS": ("calls", "src_id", "dst_id", "Symbol", "Symbol"), "IMPORTS": ("imports", "src_path", "dst_path", "File", "File"), "EXTENDS": ("heritage", "sub_id", "super_id", "Symbol", "Symbol"), "IMPLEMENTS": ("heritage", "sub_id", "super_id", "Symbol", "Symbol"),
    "DOCUMENTS": ("documents_edges", "section_id", "symbol_id", "DocSection", "Symbol"), "TESTS_FOR": ("tests_for", "test_path", "src_path", "File", "File"), "GOVERNS": ("governs", "rule_id", "symbol_id", "Rule", "Symbol"),
    "CONTAINS": ("symbols", "file", "id", "File", "Symbol"), "HAS_SECTION": ("sections", "document_path", "id", "Document", "DocSection"), "HAS_RULE": ("rules", "source_doc", "id", "Document", "Rule"),
    "HAS_FIELD": ("contract_fields", "entity_id", "id", "ContractEntity", "ContractField"), "HAS_ATTRIBUTE": ("storage_attributes", "container_id", "id", "StorageContainer", "StorageAttribute"),
}
PROPERTIES = {"startLine": "start_line", "endLine": "end_line", "isExported": "is_exported", "isTest": "is_test", "structuralHash": "structural_hash", "lineCount": "line_count", "sourceDoc": "source_doc", "documentPath": "document_path", "rawType": "raw_type", "dataType": "data_type", "calleeName": "callee_name", "count": "cnt"}
FUNCTIONS = {"tolower": "lower", "toupper": "upper", "trim": "trim", "coalesce": "coalesce", "abs": "abs", "tostring": "string", "tointeger": "int", "tofloat": "double", "replace": "replace", "reverse": "reverse", "round": "round"}
AGGREGATES = {"count": "count", "sum": "sum", "min": "min", "max": "max", "avg": "avg", "collect": "collect_list"}
LONGEST = 10
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+\.\d+|\d+(?!\.\d))|(?P<param>\$\w+)|(?P<word>[A-Za-z_]\w*|`[^`]+`)|(?P<sign><>|<=|>=|=~|\.\.|[-+*/%=<>(){}\[\].,:;|]))""")
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNION", "ORDER", "SKIP", "LIMIT"}
_WORDS = _CLAUSES | {"AND", "OR", "XOR", "NOT", "IN", "AS", "CONTAINS", "STARTS", "ENDS", "IS", "NULL", "CASE", "WHEN", "THEN", "ELSE", "END", "BY", "ASC", "DESC", "ASCENDING", "DESCENDING", "DISTINCT", "ALL"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip().rstrip(";").rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood: {text[at:at + 20]!r}")
        kind = m.lastgroup
        out.append(("key", m[kind].upper()) if kind == "word" and m[kind].upper() in _WORDS else (kind, m[kind]))
        at = m.end()
    return [*out, ("end", "")]


@dataclass
class Hop:
    kinds: list[str]
    name: str | None
    back: bool | None  # None: either direction
    low: int | None = None
    high: int | None = None


@dataclass
class Pattern:
    path: str | None = None
    nodes: list[str] = field(default_factory=list)
    hops: list[Hop] = field(default_factory=list)


@dataclass
class Item:
    sql: str
    alias: str
    aggregate: bool
    source: str


class Query:
    """One query over a graph: reads tokens and builds the relation as it goes."""

    def __init__(self, spark: SparkSession, g: SymGraph, text: str, parameters: dict):
        self.spark, self.g, self.parameters = spark, g, parameters
        self.tokens, self.at, self.fresh = tokens(text), 0, 0
        self.labels: dict[str, str] = {}
        self.properties: dict[str, list[str]] = {}
        self.patterns: list[tuple[bool, Pattern]] | None = None
        self.aggregate = False

    # tokens

    def peek(self, *wanted: str) -> bool:
        return self.tokens[self.at][1] in wanted and self.tokens[self.at][0] in ("key", "sign")

    def take(self, *wanted: str) -> bool:
        if self.peek(*wanted):
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"{wanted} was expected, not {self.tokens[self.at][1] or 'the end'!r}")

    def word(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "word":
            raise ValueError(f"a name was expected, not {value or 'the end'!r}")
        self.at += 1
        return value.strip("`")

    def name(self) -> str:
        self.fresh += 1
        return f"_v{self.fresh}"

    # expressions

    def expression(self) -> str:
        out = self._and()
        while self.peek("OR", "XOR"):
            out = f"({out} OR {self._and()})" if self.take("OR") else f"({out} <> {self._and() if self.take('XOR') else ''})"
        return out

    def _and(self) -> str:
        out = [self._not()]
        while self.take("AND"):
            out.append(self._not())
        return out[0] if len(out) == 1 else "(" + " AND ".join(out) + ")"

    def _not(self) -> str:
        return f"(NOT {self._not()})" if self.take("NOT") else self._comparison()

    def _comparison(self) -> str:
        left = self._sum()
        while True:
            if self.take("IN"):
                right = self._sum()
                left = f"array_contains({right}, {left})"
            elif self.take("CONTAINS"):
                left = f"contains({left}, {self._sum()})"
            elif self.take("STARTS"):
                self.need("WITH")
                left = f"startswith({left}, {self._sum()})"
            elif self.take("ENDS"):
                self.need("WITH")
                left = f"endswith({left}, {self._sum()})"
            elif self.take("IS"):
                left = f"({left} IS {'NOT ' if self.take('NOT') else ''}NULL)"
                self.need("NULL")
            elif self.peek("=", "<>", "<", ">", "<=", ">=", "=~"):
                sign = self.tokens[self.at][1]
                self.at += 1
                left = f"({left} {'RLIKE' if sign == '=~' else sign} {self._sum()})"
            else:
                return left

    def _sum(self) -> str:
        out = self._product()
        while self.peek("+", "-"):
            sign = self.tokens[self.at][1]
            self.at += 1
            right = self._product()
            out = f"concat({out}, {right})" if sign == "+" and (out[:1] in "'\"" or right[:1] in "'\"" or out.startswith("concat(")) else f"({out} {sign} {right})"
        return out

    def _product(self) -> str:
        out = self._unary()
        while self.peek("*", "/", "%"):
            sign = self.tokens[self.at][1]
            self.at += 1
            out = f"({out} {sign} {self._unary()})"
        return out

    def _unary(self) -> str:
        if self.take("-"):
            return f"(-{self._unary()})"
        out = self._primary()
        while self.peek(".", "["):
            if self.take("."):
                key = self.word()
                out = f"{out}.{PROPERTIES.get(key, key)}"
            else:
                self.need("[")
                out = f"get({out}, cast({self.expression()} as int))"
                self.need("]")
        return out

    def _list(self) -> str:
        items = []
        while not self.take("]"):
            items.append(self.expression())
            if not self.peek("]"):
                self.need(",")
        return f"array({', '.join(items)})"

    def _primary(self) -> str:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return quoted(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "number":
            return value
        if kind == "param":
            if value[1:] not in self.parameters:
                raise ValueError(f"no value for {value}")
            return constant(self.parameters[value[1:]])
        if (kind, value) == ("key", "NULL"):
            return "NULL"
        if (kind, value) == ("key", "CASE"):
            out = "CASE" if self.peek("WHEN") else f"CASE {self.expression()}"
            while self.take("WHEN"):
                out += f" WHEN {self.expression()}"
                self.need("THEN")
                out += f" THEN {self.expression()}"
            if self.take("ELSE"):
                out += f" ELSE {self.expression()}"
            self.need("END")
            return out + " END"
        if (kind, value) == ("sign", "["):
            return self._list()
        if (kind, value) == ("sign", "("):
            out = self.expression()
            self.need(")")
            return f"({out})"
        if kind != "word":
            raise ValueError(f"an expression was expected, not {value or 'the end'!r}")
        if value.lower() in ("true", "false"):
            return value.upper()
        return self._call(value.lower()) if self.take("(") else f"`{value.strip('`')}`"

    def _call(self, name: str) -> str:
        if name == "count" and self.take("*"):
            self.need(")")
            self.aggregate = True
            return "count(*)"
        distinct, arguments = self.take("DISTINCT"), []
        while not self.take(")"):
            arguments.append(self.expression())
            if not self.peek(")"):
                self.need(",")
        one = arguments[0] if arguments else ""
        if name in AGGREGATES:
            self.aggregate = True
            if name == "collect":
                return f"array_sort(collect_{'set' if distinct else 'list'}({one}))"
            return f"{AGGREGATES[name]}({'DISTINCT ' if distinct else ''}{one})"
        if distinct:
            raise ValueError(f"DISTINCT in {name}()")
        if name in FUNCTIONS:
            return f"cast({one} as {FUNCTIONS[name]})" if name in ("tostring", "tointeger", "tofloat") else f"{FUNCTIONS[name]}({', '.join(arguments)})"
        variable = one.strip("`")
        if name in ("labels", "id") and variable in self.labels:
            return f"array('{self.labels[variable]}')" if name == "labels" else f"`{variable}`.{NODES[self.labels[variable]][1]}"
        if name in ("type", "length", "nodes") and len(arguments) == 1:
            return f"{one}.{ {'type': '_type', 'length': 'depth', 'nodes': 'nodes'}[name]}"
        if name == "size" and len(arguments) == 1:
            return f"size({one})" if re.match(r"array|split\(|.*\.nodes$", one) else f"length({one})"
        if name == "split" and len(arguments) == 2:
            return f"split({one}, concat('\\\\Q', {arguments[1]}, '\\\\E'))"
        if name == "substring" and len(arguments) in (2, 3):
            return f"substring({one}, {arguments[1]} + 1" + (f", {arguments[2]})" if len(arguments) == 3 else ")")
        if name in ("head", "last") and len(arguments) == 1:
            return f"try_element_at({one}, {1 if name == 'head' else -1})"
        if name == "exists" and len(arguments) == 1:
            return f"({one} IS NOT NULL)"
        raise ValueError(f"unknown function {name}()")

    # patterns

    def pattern(self) -> Pattern:
        out = Pattern()
        if self.tokens[self.at][0] == "word" and self.tokens[self.at + 1] == ("sign", "="):
            out.path = self.word()
            self.at += 1
        out.nodes.append(self._node())
        while self.peek("-", "<"):
            out.hops.append(self._hop())
            out.nodes.append(self._node())
        for hop, a, b in zip(out.hops, out.nodes, out.nodes[1:]):
            ends = [EDGES[k][3:5] for k in hop.kinds]
            for n, side in ((a, 1 if hop.back else 0), (b, 0 if hop.back else 1)):
                self.labels[n] = self.labels.get(n) or ends[0][side]
        for n in out.nodes:
            self.labels[n] = self.labels.get(n) or "Symbol"
        return out

    def _node(self) -> str:
        self.need("(")
        name = self.word() if self.tokens[self.at][0] == "word" else self.name()
        if self.take(":"):
            label = self.word()
            if label not in NODES:
                raise ValueError(f"unknown label {label}")
            if self.labels.get(name, label) != label:
                raise ValueError(f"{name} is a {self.labels[name]}")
            self.labels[name] = label
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                self.properties.setdefault(name, []).append(f"{PROPERTIES.get(key, key)} = {self._sum()}")
                if not self.peek("}"):
                    self.need(",")
        self.need(")")
        return name

    def _hop(self) -> Hop:
        back = self.take("<")
        self.need("-")
        hop = Hop([], None, back)
        if self.take("["):
            if self.tokens[self.at][0] == "word":
                hop.name = self.word()
            if self.take(":"):
                hop.kinds.append(self._kind())
                while self.take("|"):
                    self.take(":")
                    hop.kinds.append(self._kind())
            if self.take("*"):
                hop.low, hop.high = 1, LONGEST
                if self.tokens[self.at][0] == "number":
                    hop.low = hop.high = int(self._primary())
                    if self.take(".."):
                        hop.high = int(self._primary()) if self.tokens[self.at][0] == "number" else LONGEST
                elif self.take(".."):
                    hop.high = int(self._primary())
                if not 1 <= hop.low <= hop.high <= LONGEST:
                    raise ValueError(f"a length is 1 to {LONGEST}")
            self.need("]")
        self.need("-")
        forth = self.take(">")
        if back and forth:
            raise ValueError("an edge has one direction")
        hop.back = back if back or forth else None
        if unknown := [k for k in hop.kinds if k not in EDGES]:
            raise ValueError(f"unknown edge type {unknown[0]}")
        hop.kinds = hop.kinds or ["CALLS"]
        return hop

    def _kind(self) -> str:
        """An edge type, also one that is a word of the language."""
        kind, value = self.tokens[self.at]
        if kind not in ("word", "key"):
            raise ValueError(f"an edge type was expected, not {value!r}")
        self.at += 1
        return value

    def _table(self, name: str, label: str) -> DataFrame:
        table = getattr(self.g, NODES[label][0])
        for condition in self.properties.get(name, []):
            table = table.where(condition)
        return table.select(F.struct("*").alias(name), F.col(NODES[label][1]).alias(f"_k_{name}"))

    def _edges(self, hop: Hop) -> DataFrame:
        """(_a, _b, _e): from the left end to the right one."""
        parts = []
        for k in hop.kinds:
            table, src, dst, *_ = EDGES[k]
            rows = getattr(self.g, table)
            rows = rows.where(F.col("rel") == k.lower()) if table == "heritage" else rows
            count = F.col("cnt") if "cnt" in rows.columns else F.lit(None).cast("long")
            line = F.col("line").cast("int") if "line" in rows.columns else F.lit(None).cast("int")
            own = rows.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("_s"), F.col(dst).alias("_d"), F.struct(F.lit(k).alias("_type"), count.alias("cnt"), line.alias("line")).alias("_e"))
            forth, back = own.select(F.col("_s").alias("_a"), F.col("_d").alias("_b"), "_e"), own.select(F.col("_d").alias("_a"), F.col("_s").alias("_b"), "_e")
            parts += [forth] if hop.back is False else [back] if hop.back else [forth, back]
        return reduce(DataFrame.unionByName, parts)

    def relation(self, patterns: list[Pattern]) -> DataFrame:
        """The patterns of one clause, joined by the variables they share."""
        out: DataFrame | None = None
        waiting = list(patterns)
        while waiting:
            bound = set(out.columns) if out is not None else set()
            p = next((p for p in waiting if out is None or bound & set(p.nodes)), None)
            if p is None:
                raise ValueError("patterns of one MATCH have to share a variable")
            waiting.remove(p)
            own = self._chain(p)
            out = own if out is None else joined(out, own, "inner")
        return out

    def _chain(self, p: Pattern) -> DataFrame:
        out = self._table(p.nodes[0], self.labels[p.nodes[0]])
        for i, hop in enumerate(p.hops):
            left, right = p.nodes[i], p.nodes[i + 1]
            if hop.high is None:
                edges = self._edges(hop)
            else:
                plain = self._edges(hop).select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()
                walked = trails(plain, out.select(F.col(f"_k_{left}").alias("seed")).distinct(), hop.high).where(F.col("depth") >= hop.low)
                edges = walked.select(F.col("seed").alias("_a"), F.col("node").alias("_b"), F.struct("depth", "nodes").alias("_e"))
            out = out.join(edges, F.col(f"_k_{left}") == F.col("_a"))
            if hop.name:
                out = out.withColumn(hop.name, F.col("_e"))
            if p.path:
                steps = F.col("_e.depth") if hop.high else F.lit(1)
                more = F.slice("_e.nodes", F.lit(2), F.size("_e.nodes")) if hop.high else F.array("_b")
                before = F.col(p.path) if i else F.struct(F.lit(0).alias("depth"), F.array("_a").alias("nodes"))
                out = out.withColumn(p.path, F.struct((before["depth"] + steps).alias("depth"), F.concat(before["nodes"], more).alias("nodes")))
            if right in out.columns:
                out = out.where(F.col("_b") == F.col(f"_k_{right}")).drop("_a", "_b", "_e")
            else:
                out = out.join(self._table(right, self.labels[right]), F.col("_b") == F.col(f"_k_{right}")).drop("_a", "_b", "_e")
        return out

    # clauses

    def run(self) -> DataFrame:
        out, kinds = self._single(), set()
        while self.take("UNION"):
            kinds.add(self.take("ALL"))
            self.labels, self.properties = {}, {}
            more = self._single()
            if more.columns != out.columns:
                raise ValueError("the parts of a UNION return different columns")
            out = out.unionByName(more)
        if self.tokens[self.at][0] != "end":
            raise ValueError(f"not understood: {self.tokens[self.at][1]!r}")
        if len(kinds) > 1:
            raise ValueError("UNION and UNION ALL in one query")
        return out if kinds in (set(), {True}) else out.distinct()

    def _single(self) -> DataFrame:
        now: DataFrame | None = None
        while True:
            if self.peek("MATCH", "OPTIONAL"):
                now = self._match(now)
            elif self.take("WITH"):
                if now is None:
                    raise ValueError("WITH has nothing before it")
                now = self._project(now, final=False)
                if self.take("WHERE"):
                    now = self._where(now)
            elif self.take("RETURN"):
                if now is None:
                    raise ValueError("RETURN has nothing before it")
                return self._project(now, final=True)
            else:
                raise ValueError(f"a clause was expected, not {self.tokens[self.at][1] or 'the end'!r}; only reading is supported")

    def _match(self, now: DataFrame | None) -> DataFrame:
        optional = self.take("OPTIONAL")
        self.need("MATCH")
        self.properties = {}
        patterns = [self.pattern()]
        while self.take(","):
            patterns.append(self.pattern())
        if optional and now is None:
            raise ValueError("OPTIONAL MATCH has nothing before it")
        fresh = self.relation(patterns)
        if not optional:
            now = fresh if now is None else joined(now, fresh, "inner")
            return self._where(now) if self.take("WHERE") else now
        if self.take("WHERE"):  # the condition is one of the match, so what it does not hold for stays, without
            shared = [c for c in fresh.columns if c in now.columns]
            outside = [c for c in now.columns if c not in fresh.columns]
            mark = self.at
            text = {v.strip("`") for k, v in self.tokens[mark:] if k == "word"}
            if text & {c for c in outside if not c.startswith("_k_")}:
                raise ValueError("a condition of OPTIONAL MATCH is on its own variables")
            fresh = self._where(fresh)
            if not shared:
                raise ValueError("OPTIONAL MATCH has to share a variable with what is before it")
        return joined(now, fresh, "left")

    def _where(self, now: DataFrame) -> DataFrame:
        """A condition. Where patterns are in it, it is a conjunction: a pattern, or one with NOT before it, is a semi or anti join."""
        mark, kept = self.at, dict(self.labels)
        try:
            plain = self.expression()
            if self.tokens[self.at][0] == "end" or self.peek(*_CLAUSES):
                return now.where(plain)
        except ValueError:
            pass
        self.at, self.labels = mark, kept
        while True:
            mark, negated = self.at, self.take("NOT")
            kept = dict(self.labels)
            try:
                self.properties = {}
                p = self.pattern()
                is_pattern = bool(p.hops)
            except ValueError:
                is_pattern = False
            if is_pattern:
                own = self._chain(p)
                keys = [c for c in own.columns if c.startswith("_k_") and c in now.columns]
                if not keys:
                    raise ValueError("a pattern as a condition has to share a variable")
                now = now.join(own.select(*keys).distinct(), keys, "left_anti" if negated else "left_semi").select(*now.columns)
            else:
                self.at, self.labels = mark, kept
                now = now.where(self._not())
            if self.peek("OR", "XOR"):
                raise ValueError("a pattern as a condition beside OR is not supported")
            if not self.take("AND"):
                return now

    def _project(self, now: DataFrame, final: bool) -> DataFrame:
        distinct = self.take("DISTINCT")
        items = [self._item()]
        while self.take(","):
            items.append(self._item())
        order, most, skip = [], None, None
        if self.take("ORDER"):
            self.need("BY")
            while True:
                mark = self.at
                sql = self.expression()
                source = self._source(mark)
                order.append((sql, source, self.take("DESC", "DESCENDING")))
                self.take("ASC", "ASCENDING")
                if not self.take(","):
                    break
        if self.take("SKIP"):
            skip = int(self._primary())
        if self.take("LIMIT"):
            most = int(self._primary())
        grouped = any(i.aggregate for i in items)
        columns = [F.expr(i.sql).alias(i.alias) for i in items]
        carried = [f"_k_{i.source}" for i in items if f"_k_{i.source}" in now.columns and i.source == i.alias] if not final else []
        sort, hidden = [], []
        for sql, source, down in order:
            own = next((i.alias for i in items if i.source == source or i.alias == source), None)
            if own is None:
                if grouped or distinct:
                    raise ValueError(f"ORDER BY {source} is not returned")
                own = f"_o{len(hidden)}"
                hidden.append(F.expr(sql).alias(own))
            sort.append(F.col(f"`{own}`").desc() if down else F.col(f"`{own}`").asc())
        if grouped:
            keys = [c for c, i in zip(columns, items) if not i.aggregate] + [F.col(c) for c in carried]
            out = now.groupBy(*keys).agg(*[c for c, i in zip(columns, items) if i.aggregate])
        else:
            out = now.select(*columns, *carried, *hidden)
        if distinct:
            out = out.distinct()
        if sort:
            out = out.orderBy(*sort)
        if skip:
            out = out.offset(skip)
        if most is not None:
            out = out.limit(most)
        if not final:
            passed = {i.alias: self.labels[i.source] for i in items if i.source in self.labels}
            self.labels = passed
        return out.select(*[F.col(f"`{i.alias}`") for i in items], *carried)

    def _source(self, mark: int) -> str:
        return "".join(v if k != "key" else f" {v} " for k, v in self.tokens[mark : self.at]).strip()

    def _item(self) -> Item:
        mark, self.aggregate = self.at, False
        sql = self.expression()
        source = self._source(mark)
        alias = self.word() if self.take("AS") else re.sub(r"[^A-Za-z0-9_]+", "_", source).strip("_")
        return Item(sql, alias, self.aggregate, source)


def joined(now: DataFrame, fresh: DataFrame, how: str) -> DataFrame:
    """By the keys of the variables that both have; a variable's own columns are kept once."""
    keys = [c for c in fresh.columns if c.startswith("_k_") and c in now.columns]
    if not keys:
        raise ValueError("clauses have to share a variable")
    again = [c for c in fresh.columns if c in now.columns and c not in keys]
    return now.join(fresh.drop(*again), keys, how).select(*now.columns, *[c for c in fresh.columns if c not in now.columns])


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant(value) -> str:
    """A parameter as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(constant, value))})" if value else "cast(array() as array<string>)"
    raise ValueError(f"no constant: {value!r}")


def match(spark: SparkSession, g: SymGraph, text: str, **parameters) -> DataFrame:
    """Run a query of the pattern language; ValueError for what is no such query or cannot be translated."""
    return Query(spark, g, text, parameters).run()
