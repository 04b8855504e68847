"""A row-transform language: statements over each row, with windows, lookups and aggregating joins.

    FE_N = FE / mean(FE) over LITHO
    RUN = sum(LEN) over BHID order DEPTH where LEN > 0
    D = lookup densities.density where densities.litho == LITHO
    CODE = lookup domains.code where domains.hole == hole and domains.from <= DEPTH < domains.to
    A = wmean(assays.fe, overlap) where assays.hole == hole and overlap(assays.from, assays.to, FROM, TO)
    if (FE >= 64) ... elseif (...) ... else ... end,  match x {>= 64: "A", _: "B"},  let t = ...,  delete, exit
    check "name": test,  require "name": test,  keep(..), saveonly(..), erase(..)

Absent is NULL or NaN: comparisons with it are false, arithmetic gives it, ``not`` of a false comparison is true. Windows and joins are
planned on the input rows before any statement: group aggregates are computed once per group and joined, so that
a hot group is combined before the shuffle; running ones are windows. Lookups and joins with one predicate share one join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blanks as B
from ..operators.windows import with_last
from .shared import keep
from .syntax import Cursor, Node, SyntaxFault, lex

WINDOWS = frozenset("count sum mean min max std wmean".split())
POSITIONAL = frozenset("prev next first last".split())
RESERVED = frozenset("and or not over order where absent true false lookup match if elseif else end let default".split())


@dataclass
class Statement:
    kind: str
    name: str = ""
    value: Node | None = None
    type: str = ""
    unit: str = ""
    default: Node | None = None
    clauses: list[tuple[Node | None, list]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


class Rows(Cursor):
    def program(self, until: tuple[str, ...] = ()) -> list[Statement]:
        out = []
        while True:
            while self.now.kind == "newline":
                self.take()
            if self.now.kind == "end" or (until and self.word(*until)):
                return out
            out.append(self.statement())
            if self.now.kind not in ("newline", "end") and not (until and self.word(*until)):
                self.fail("expected the end of the line")

    def statement(self) -> Statement:
        if self.word("if"):
            return self.branches()
        if self.word("delete", "exit") and not self.assigns(1):
            return Statement(self.take().text)
        if self.word("keep", "saveonly", "erase") and self.ahead().text == "(":
            kind = self.take().text
            self.eat("(")
            names = [self.take().text]
            while self.op(","):
                self.take()
                names.append(self.take().text)
            self.eat(")")
            return Statement(kind, names=names)
        if self.word("check", "require") and self.ahead().kind == "str":
            kind, name = self.take().text, self.take().text
            self.eat(":")
            return Statement(kind, name, self.expression())
        kind = "assign"
        if self.word("let"):
            self.take()
            kind = "let"
        if self.now.kind not in ("word", "field"):
            self.fail("expected a statement")
        out = Statement(kind, self.take().text)
        if self.op(":"):
            self.take()
            out.type = self.take().text
        if self.word("default"):
            self.take()
            out.default = self.sign()
        self.eat("=")
        out.value = self.expression()
        return out

    def assigns(self, n: int) -> bool:
        return self.ahead(n).text in ("=", ":")

    def branches(self) -> Statement:
        out = Statement("if")
        while True:
            word = self.take().text.lower()
            test = None if word == "else" else self.expression()
            out.clauses.append((test, self.program(("elseif", "else", "end"))))
            if self.word("end"):
                self.take()
                return out
            if self.now.kind == "end":
                self.fail("expected 'end'")

    def expression(self) -> Node:
        out = self.either()
        while self.op("??"):
            self.take()
            out = Node("default", (out, self.either()))
        return out

    def either(self) -> Node:
        out = self.both()
        while self.word("or"):
            self.take()
            out = Node("or", (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.word("and"):
            self.take()
            out = Node("and", (out, self.negated()))
        return out

    def negated(self) -> Node:
        if self.word("not"):
            self.take()
            return Node("not", (self.negated(),))
        return self.comparison()

    def comparison(self) -> Node:
        left, out = self.sum(), None
        while self.op("<", ">", "<=", ">=", "==", "!="):
            o = self.take().text
            right = self.sum()
            one = Node("compare", (o, left, right))
            out, left = one if out is None else Node("and", (out, one)), right
        return left if out is None else out

    def sum(self) -> Node:
        out = self.product()
        while self.op("+", "-"):
            o = self.take().text
            out = Node("arithmetic", (o, out, self.product()))
        return out

    def product(self) -> Node:
        out = self.sign()
        while self.op("*", "/"):
            o = self.take().text
            out = Node("arithmetic", (o, out, self.sign()))
        return out

    def sign(self) -> Node:
        if self.op("-"):
            self.take()
            return Node("negative", (self.sign(),))
        base = self.primary()
        if self.op("^", "**"):
            self.take()
            return Node("call", ("pow", (base, self.sign())))
        return base

    def path(self) -> Node:
        name = self.take().text
        if self.op(".") and self.ahead().kind in ("word", "field"):
            self.take()
            return Node("reference", (name, self.take().text))
        return Node("field", (name,))

    def primary(self) -> Node:
        t = self.now
        if self.op("("):
            self.take()
            inner = self.expression()
            self.eat(")")
            return inner
        if t.kind == "num":
            self.take()
            return Node("number", (float(t.text),))
        if t.kind == "str":
            self.take()
            return Node("text", (t.text,))
        if t.kind == "field":
            return self.path()
        if t.kind != "word":
            self.fail("unexpected token")
        word = t.text.lower()
        if word in ("true", "false"):
            self.take()
            return Node("bool", (word == "true",))
        if word == "absent":
            self.take()
            return Node("absent")
        if word == "lookup":
            self.take()
            value = self.path()
            if value.kind != "reference":
                self.fail("lookup takes TABLE.column")
            self.eat("where")
            return Node("lookup", (value, self.either()))
        if word == "match":
            return self.match()
        if self.ahead().text == "(" and self.ahead().kind == "op":
            return self.call(self.take().text)
        return self.path()

    def match(self) -> Node:
        self.take()
        subject = self.sum()
        self.eat("{")
        arms = []
        while not self.op("}"):
            while self.now.kind == "newline" or self.op(","):
                self.take()
            if self.op("}"):
                break
            if self.op("<", ">", "<=", ">=", "==", "!="):
                o = self.take().text
                test = Node("compare", (o, subject, self.sum()))
            elif self.now.text == "_":
                self.take()
                test = None
            else:
                arm = self.either()
                test = arm if arm.kind in ("compare", "and", "or", "not") else Node("compare", ("==", subject, arm))
            self.eat(":")
            arms.append((test, self.expression()))
            while self.now.kind == "newline" or self.op(","):
                self.take()
        self.eat("}")
        return Node("match", (tuple(arms),))

    def call(self, name: str) -> Node:
        self.eat("(")
        args = []
        while not self.op(")"):
            args.append(self.expression())
            if self.op(","):
                self.take()
        self.eat(")")
        if self.word("over"):
            if name not in WINDOWS | POSITIONAL:
                self.fail(f"{name} is not a window function")
            self.take()
            groups = [self.take().text]
            while self.op(","):
                self.take()
                groups.append(self.take().text)
            order = None
            if self.word("order"):
                self.take()
                order = self.take().text
            if name in POSITIONAL and not order:
                self.fail(f"{name} needs an order")
            test = None
            if self.word("where"):
                self.take()
                test = self.either()
            return Node("window", (name, tuple(args), () if groups == ["all"] else tuple(groups), order, test))
        if self.word("where") and name in WINDOWS:
            self.take()
            return Node("joined", (name, tuple(args), self.either()))
        return Node("call", (name, tuple(args)))


def parse(source: str) -> list[Statement]:
    return Rows(lex(source)).program()


def walk(node):
    """A node and all below it."""
    if isinstance(node, Node):
        yield node
        for a in node.args:
            yield from walk(a)
    elif isinstance(node, tuple):
        for a in node:
            yield from walk(a)


def statements(program: list[Statement]):
    for s in program:
        yield s
        for _, body in s.clauses:
            yield from statements(body)


def nodes(program: list[Statement]):
    for s in statements(program):
        for n in (s.value, s.default, *(t for t, _ in s.clauses)):
            yield from walk(n)


def conjuncts(node: Node) -> list[Node]:
    if node.kind == "and":
        return conjuncts(node.args[0]) + conjuncts(node.args[1])
    return [node]


FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def shape(predicate: Node) -> tuple[str, list[tuple[str, Node]], list[tuple[str, str, Node]], Node | None]:
    """Table, equalities (column, own side), ranges (column, operator, own side) and an overlap call of a join's predicate."""
    table, equal, ranges, overlap = None, [], [], None
    for c in conjuncts(predicate):
        if c.kind == "call" and c.args[0] == "overlap":
            overlap = c
            table = c.args[1][0].args[0]
            continue
        if c.kind != "compare":
            raise SyntaxFault("conditions of a lookup are comparisons joined by 'and'")
        o, a, b = c.args
        if b.kind == "reference":
            o, a, b = FLIP[o], b, a
        if a.kind != "reference":
            raise SyntaxFault("compare t.column with a value of the row")
        table = table or a.args[0]
        if o == "==":
            equal.append((a.args[1], b))
        else:
            ranges.append((a.args[1], o, b))
    if ranges and sorted(o[0] for _, o, _ in ranges) != ["<", ">"]:
        raise SyntaxFault("a range needs one lower and one upper bound")
    return table, equal, ranges, overlap


NUMERIC = {
    "sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "abs": F.abs, "log": F.log, "loge": F.log, "logn": F.log, "log10": F.log10,
    "int": B.truncate, "round": B.round_half_up, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"),
}


class Plan:
    """Compiles statements on a frame."""

    def __init__(self, df: DataFrame, references: dict[str, DataFrame], order: list[str]):
        self.df, self.references, self.order = df, references, order
        self.input = df.columns
        self.planned: dict[Node, str] = {}
        self.shared: dict[tuple, str] = {}
        self.defaults: dict[str, Node] = {}

    # values

    def value(self, node: Node) -> Column:
        k, a = node.kind, node.args
        if node in self.planned:
            return F.col(self.planned[node])
        if k == "field":
            if a[0] not in self.df.columns:
                raise SyntaxFault(f"no column {a[0]!r}")
            kind = self.df.schema[a[0]].dataType
            c = F.col(f"`{a[0]}`")
            return B.null_if_nan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
        if k in ("number", "text", "bool"):
            return F.lit(a[0])
        if k == "absent":
            return F.lit(None)
        if k == "negative":
            return -self.value(a[0])
        if k == "arithmetic":
            return self.arithmetic(a[0], self.value(a[1]), self.value(a[2]))
        if k == "compare":
            if "absent" in (a[1].kind, a[2].kind):
                there = self.value(a[1] if a[2].kind == "absent" else a[2])
                return there.isNull() if a[0] == "==" else there.isNotNull()
            x, y = self.value(a[1]), self.value(a[2])
            return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[a[0]], F.lit(False))
        if k == "and":
            return self.truth(a[0]) & self.truth(a[1])
        if k == "or":
            return self.truth(a[0]) | self.truth(a[1])
        if k == "not":
            return ~self.truth(a[0])
        if k == "default":
            return F.coalesce(self.value(a[0]), self.value(a[1]))
        if k == "match":
            out = F
            for test, v in a[0]:
                if test is None:
                    return out.otherwise(self.value(v)) if out is not F else self.value(v)
                out = out.when(self.truth(test), self.value(v))
            return out
        if k == "call":
            return self.call(a[0], a[1])
        raise SyntaxFault(f"{k} is not allowed here")

    def truth(self, node: Node) -> Column:
        return F.coalesce(self.value(node).cast("boolean"), F.lit(False))

    @staticmethod
    def arithmetic(o: str, x: Column, y: Column) -> Column:
        if o == "/":
            x, y = x.cast("double"), y.cast("double")
            return F.when(y != 0, F.try_divide(x, y)).when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[o]()

    def call(self, name: str, nodes: tuple) -> Column:
        if name == "default":
            (target,) = nodes
            return F.coalesce(self.value(target), self.value(self.defaults[target.args[0]]))
        v = [self.value(n) for n in nodes]
        if name in NUMERIC:
            return NUMERIC[name](v[0].cast("double"))
        if name in ("pow", "rais"):
            return F.pow(*v)
        if name == "atan2":
            return F.atan2(*v)
        if name == "mod":
            return F.when(v[1] != 0, v[0] % v[1])
        if name in ("min", "max"):
            one = F.least(*v) if name == "min" else F.greatest(*v)
            there = v[0].isNotNull()
            for c in v[1:]:
                there &= c.isNotNull()
            return F.when(there, one)
        if name in ("minia", "maxia"):
            return F.least(*v) if name == "minia" else F.greatest(*v)
        if name == "present":
            return v[0].isNotNull()
        if name == "len":
            return F.coalesce(F.char_length(v[0]), F.lit(0))
        if name in ("ucase", "lcase", "trim"):
            return {"ucase": F.upper, "lcase": F.lower, "trim": F.trim}[name](v[0])
        if name == "string":
            return v[0].cast("string")
        if name == "concat":
            return F.concat_ws("", *[c.cast("string") for c in v])
        if name == "substr":
            return F.substr(v[0], (v[1] + 1).cast("int"), v[2].cast("int")) if len(v) > 2 else F.substr(v[0], (v[1] + 1).cast("int"))
        if name == "bin":
            return F.when(v[0].isNotNull(), sum(((v[0] >= b).cast("int") for b in v[1:]), F.lit(0)))
        if name == "binlabel":
            texts = [str(n.args[0]).removesuffix(".0") for n in nodes[1:]]
            out = F.when(v[0] < v[1], f"< {texts[0]}")
            for low, high, edge in zip(texts, texts[1:], v[2:]):
                out = out.when(v[0] < edge, f"{low} - {high}")
            return out.when(v[0] >= v[-1], f">= {texts[-1]}")
        if name in ("if", "iif"):
            return F.when(self.truth(nodes[0]), v[1]).otherwise(v[2])
        raise SyntaxFault(f"no function {name}")

    # windows and joins, on the input rows

    def aggregate(self, name: str, args: list[Column], test: Column | None = None) -> Column:
        pick = lambda c: c if test is None else F.when(test, c)
        if name == "count":
            return F.count(pick(F.lit(1)))
        if name == "wmean":
            both = args[0].isNotNull() & args[1].isNotNull()
            return F.try_divide(F.sum(pick(F.when(both, args[0] * args[1]))), F.sum(pick(F.when(both, args[1]))))
        c = pick(args[0])
        if name == "std":
            return F.when(F.count(c) > 0, F.coalesce(F.stddev_pop(c), F.lit(0.0)))
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[name](c)

    def name(self) -> str:
        return f"__p{len(self.planned)}_{len(self.shared)}"

    def prepare(self, program: list[Statement]) -> None:
        for node in nodes(program):
            if node.kind == "window" and node not in self.planned:
                self.window(node)
            elif node.kind == "lookup" and node not in self.planned:
                self.lookup(node)
            elif node.kind == "joined" and node not in self.planned:
                self.joined(node)

    def window(self, node: Node) -> None:
        name, args, groups, order, test = node.args
        out, v = self.name(), [self.value(a) for a in args]
        ok = self.truth(test) if test is not None else None
        if order is None:
            agg = self.aggregate(name, v, ok).alias(out)
            if not groups:
                self.df = self.df.crossJoin(F.broadcast(self.df.agg(agg)))  # one row
            else:
                keys = [F.col(f"`{g}`").alias(f"__k{i}") for i, g in enumerate(groups)]
                own = keep(self.df.groupBy(*keys).agg(agg))  # its size is known, so a few groups go to the rows rather than the rows to them
                on = [F.col(f"`{g}`").eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(groups)]
                self.df = self.df.join(own, on, "left").drop(*[f"__k{i}" for i in range(len(groups))])
        else:
            passing = F.lit(True) if ok is None else ok
            base = Window.partitionBy(passing.alias("ok"), *[F.col(f"`{g}`") for g in groups]).orderBy(F.col(f"`{order}`").asc_nulls_last(), *self.order)
            running = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            whole = base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            if name in ("prev", "next"):
                c = (F.lag if name == "prev" else F.lead)(v[0]).over(base)
            elif name in ("first", "last"):
                c = (F.first if name == "first" else F.last)(v[0]).over(whole)
            elif name == "std":
                c = F.when(F.count(v[0]).over(running) > 0, F.coalesce(F.stddev_pop(v[0]).over(running), F.lit(0.0)))
            elif name == "wmean":
                both = v[0].isNotNull() & v[1].isNotNull()
                c = F.try_divide(F.sum(F.when(both, v[0] * v[1])).over(running), F.sum(F.when(both, v[1])).over(running))
            else:
                c = self.aggregate(name, v).over(running)
            self.df = self.df.withColumn(out, c if ok is None else F.when(ok, c))
        self.planned[node] = out

    def reference(self, table: str) -> DataFrame:
        if table not in self.references:
            raise SyntaxFault(f"table {table!r} was not provided")
        return self.references[table]

    def lookup(self, node: Node) -> None:
        value, predicate = node.args
        table, equal, ranges, _ = shape(predicate)
        key = (table, predicate)
        if key not in self.shared:
            ref = self.reference(table)
            wanted = sorted({n.args[1] for m in self.all_lookups if m.args[1] == predicate for n in [m.args[0]]})
            out = self.name()
            rows = ref.withColumn("__seq", F.col(self.ref_order[table]) if table in self.ref_order else F.monotonically_increasing_id())
            keys = [F.col(f"`{c}`").cast("string").alias(f"__e{i}") for i, (c, _) in enumerate(equal)]
            payload = F.struct(*[F.col(f"`{c}`") for c in wanted])
            mine = [self.value(v).cast("string").eqNullSafe(F.col(f"__e{i}")) for i, (_, v) in enumerate(equal)]
            if not ranges:
                found = rows.groupBy(*keys).agg(F.min_by(payload, "__seq").alias(out))
                self.df = self.df.join(found, mine, "left").drop(*[f"__e{i}" for i in range(len(equal))])
            else:
                (low, lo_op, at), (high, hi_op, top) = sorted(ranges, key=lambda r: r[1][0] == ">")
                # intervals and rows in one order: each row gets the last interval that starts before it
                at, top = self.value(at).cast("double"), self.value(top).cast("double")
                held = keep(self.df.withColumn("__row", F.monotonically_increasing_id()))
                names = [f"__e{i}" for i in range(len(equal))]
                start, place = F.col(f"`{low}`").cast("double"), [F.lit(1 if lo_op == "<=" else -1).alias("__tie"), F.lit(None).cast(rows.schema["__seq"].dataType).alias("__seq")]
                found = rows.where(start.isNotNull()).select(*keys, start.alias("__at"), F.lit(0).alias("__tie"), "__seq", F.struct(F.col(f"`{high}`").cast("double").alias("hi"), payload.alias("v")).alias("__r"))
                asked = held.where(at.isNotNull()).select(*[self.value(v).cast("string").alias(n) for n, (_, v) in zip(names, equal)], at.alias("__at"), *place, "__row", top.alias("__top"))
                both = with_last(found.unionByName(asked, allowMissingColumns=True), "__r", names, ["__at", "__tie", "__seq"], "__last").where("__row is not null")
                inside = F.col("__top") < F.col("__last.hi") if hi_op == ">" else F.col("__top") <= F.col("__last.hi")
                self.df = held.join(both.select("__row", F.when(inside, F.col("__last.v")).alias(out)), "__row", "left").drop("__row")
            self.shared[key] = out
        self.df = self.df.withColumn(name := self.name(), F.col(self.shared[key])[value.args[1]])
        self.planned[node] = name

    def joined(self, node: Node) -> None:
        name, args, predicate = node.args
        table, equal, _, overlap = shape(predicate)
        ref, out = self.reference(table), self.name()
        renamed = ref.select([F.col(f"`{c}`").alias(f"__r_{c}") for c in ref.columns])
        here = any(x.kind == "field" and x.args[0] != "overlap" for a in args for x in walk(a))
        asked: dict[str, Column] = {}

        def mine(c: Column) -> Column:
            """A value of this row; where pairs are needed it is a column of what is asked."""
            if overlap is None and not here:
                return c
            asked[at := f"__q{len(asked)}"] = c
            return F.col(at)

        on = [mine(self.value(v)).eqNullSafe(F.col(f"__r_{c}")) for c, v in equal]
        extent = None
        if overlap is not None:
            lo, hi, start, end = overlap.args[1]
            lo, hi = F.col(f"__r_{lo.args[1]}"), F.col(f"__r_{hi.args[1]}")
            start, end = mine(self.value(start)), mine(self.value(end))
            on += [lo < end, hi > start]
            extent = F.greatest(F.lit(0.0), F.least(end, hi) - F.greatest(start, lo))

        def argument(n: Node) -> Column:
            if n.kind == "reference":
                return F.col(f"__r_{n.args[1]}")
            if n.kind == "field" and n.args[0] == "overlap":
                return extent
            if n.kind == "arithmetic":
                return self.arithmetic(n.args[0], argument(n.args[1]), argument(n.args[2]))
            return mine(self.value(n))

        v = [argument(a) for a in args]
        if overlap is None and not here:  # nothing of this row is asked for: one aggregate per key
            keys = [f"__r_{c}" for c, _ in equal]
            found = renamed.groupBy(*keys).agg(self.aggregate(name, v).alias(out))
            self.df = self.df.join(found, on, "left").drop(*keys)
        else:
            # rows that ask the same meet the others once
            rows = self.df.withColumns(asked)
            asks = keep(rows.select(*asked).distinct().withColumn("__row", F.monotonically_increasing_id()))
            each = asks
            if extent is not None and not equal:
                each, renamed, on = self.binned(asks, renamed, (start, end), (lo, hi), on)
            matched = each.join(renamed, on).groupBy("__row").agg(self.aggregate(name, v).alias(out))
            found = keep(asks.join(matched, "__row").select(*[F.col(q).alias(f"__f{q}") for q in asked], out))
            self.df = rows.join(found, [F.col(q).eqNullSafe(F.col(f"__f{q}")) for q in asked], "left").drop(*asked, *[f"__f{q}" for q in asked])
        if name == "count":
            self.df = self.df.withColumn(out, F.coalesce(out, F.lit(0)))
        self.planned[node] = out

    @staticmethod
    def binned(rows: DataFrame, others: DataFrame, mine: tuple[Column, Column], theirs: tuple[Column, Column], on: list[Column]) -> tuple[DataFrame, DataFrame, list[Column]]:
        """Both sides once for each bin of the mean interval's length that they touch; a pair meets in the first bin that it shares."""
        length = lambda c: F.avg(F.abs(c[1] - c[0]))
        width = max([x for x in (rows.agg(length(mine)).first()[0], others.agg(length(theirs)).first()[0]) if x and x < float("inf")], default=1.0)
        place = lambda c: F.floor(c / F.lit(float(width)))
        touched = lambda c: F.explode_outer(F.when(c[0].isNotNull() & c[1].isNotNull(), F.sequence(place(F.least(*c)), place(F.greatest(*c)))))
        left = rows.withColumn("__first", F.least(*mine)).withColumn("__bin", touched(mine))
        right = others.withColumn("__r___first", F.least(*theirs)).withColumn("__r___bin", touched(theirs))
        return left, right, [*on, F.col("__bin") == F.col("__r___bin"), F.col("__bin") == place(F.greatest("__first", "__r___first"))]

    # statements

    def run(self, program: list[Statement]) -> tuple[DataFrame, list[Statement]]:
        self.all_lookups = [n for n in nodes(program) if n.kind == "lookup"]
        self.prepare(program)
        self.df = self.df.withColumn("__live", F.lit(True)).withColumn("__exit", F.lit(False))
        self.scratch: set[str] = set()
        self.checks: list[Statement] = []
        self.project: list[Statement] = []
        self.body(program, None)
        df = self.df
        if any(s.kind == "exit" for s in statements(program)):
            place = F.struct(*self.order)
            first = df.agg(F.min(F.when(F.col("__exit"), place)).alias("__first"))
            df = df.crossJoin(F.broadcast(first)).where(F.col("__first").isNull() | (place <= F.col("__first"))).drop("__first")
        return df, self.checks

    def body(self, program: list[Statement], guard: str | None) -> None:
        for i, s in enumerate(program):
            go = F.col("__live") & ~F.col("__exit")
            if guard:
                go &= F.col(guard)
            if s.kind in ("assign", "let"):
                if s.default is not None:
                    self.defaults[s.name] = s.default
                v = self.value(s.value)
                if s.type:
                    v = v.try_cast({"int": "long", "float": "double", "bool": "boolean", "string": "string", "category": "string"}[s.type])
                old = F.col(f"`{s.name}`") if s.name in self.df.columns else F.lit(None)
                self.df = self.df.withColumn(s.name, F.when(go, v).otherwise(old))
                if s.kind == "let" and s.name not in self.input:
                    self.scratch.add(s.name)
            elif s.kind == "if":
                taken = None
                for k, (test, inner) in enumerate(s.clauses):
                    mark = f"__g{len([c for c in self.df.columns if c.startswith('__g')])}"
                    own = self.truth(test) if test is not None else F.lit(True)
                    cond = go & own
                    if taken is not None:
                        cond &= ~taken
                    self.df = self.df.withColumn(mark, cond)
                    taken = F.col(mark) if taken is None else taken | F.col(mark)
                    self.body(inner, mark)
            elif s.kind == "delete":
                self.df = self.df.withColumn("__live", F.col("__live") & ~go)
            elif s.kind == "exit":
                self.df = self.df.withColumn("__exit", F.col("__exit") | go)
            elif s.kind in ("check", "require"):
                self.df = self.df.withColumn(f"__c{len(self.checks)}", F.when(go, self.truth(s.value)))
                self.checks.append(s)
            else:
                self.project.append(s)


class CheckFault(ValueError):
    pass


class Transform:
    """A parsed program. ``run`` gives the rows, ``checks`` what the checks found."""

    def __init__(self, source: str):
        self.program = parse(source)

    def _plan(self, df: DataFrame, references: dict[str, DataFrame] | None, order: list[str], ref_order: dict[str, str] | None) -> tuple[Plan, DataFrame]:
        p = Plan(df, references or {}, order)
        p.ref_order = ref_order or {}
        out, _ = p.run(self.program)
        return p, out

    def run(self, df: DataFrame, references: dict[str, DataFrame] | None = None, order: list[str] | None = None, ref_order: dict[str, str] | None = None) -> DataFrame:
        p, out = self._plan(df, references, order or [], ref_order)
        needed = [i for i, s in enumerate(p.checks) if s.kind == "require"]
        if needed:
            bad = out.agg(*[F.sum((~F.col(f"__c{i}")).cast("int")).alias(str(i)) for i in needed]).first()
            failed = [p.checks[i].name for i in needed if bad[str(i)]]
            if failed:
                raise CheckFault(f"required: {', '.join(failed)}")
        names = [c for c in out.columns if not c.startswith("__") and c not in p.scratch]
        for s in p.project:
            if s.kind in ("keep", "saveonly"):
                names = list(s.names)
            else:
                names = [c for c in names if c not in s.names]
        return out.where("__live").select(*[F.col(f"`{c}`") for c in names])

    def checks(self, df: DataFrame, references: dict[str, DataFrame] | None = None, order: list[str] | None = None) -> DataFrame:
        """``name, passed, failed`` of every check, in one pass."""
        p, out = self._plan(df, references, order or [], None)
        pairs = [F.struct(F.lit(s.name).alias("name"), F.count_if(F.col(f"__c{i}")).alias("passed"), F.count_if(~F.col(f"__c{i}")).alias("failed")) for i, s in enumerate(p.checks)]
        return out.agg(F.array(*pairs).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def schema_of(source: str, df: DataFrame, references: dict[str, DataFrame] | None = None) -> list[tuple[str, str]]:
    """Output columns and types, before any row is read."""
    return Transform(source).run(df.limit(0), references, order=df.columns[:1]).dtypes
