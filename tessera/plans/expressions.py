"""The expression language as Spark columns: total, blank-aware, names without regard to case.

Blank is NULL, NaN or ''. Blanks equal each other and nothing else, ordering on a blank is blank, arithmetic on a blank is blank,
a filter keeps what is true, and ``not`` is the complement of that. Numbers and numeric text compare as numbers, anything else as
text. ``to_filter`` leaves plain comparisons as they are, so they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blanks as B
from .syntax import Node, SyntaxFault, fields_of, parse

Typed = tuple[Column, str]


class Scope:
    """The columns of a frame by lower-cased name, with their kinds."""

    def __init__(self, df: DataFrame, decimal: str = "."):
        self.read = B.comma_number if decimal == "," else B.number
        self.columns: dict[str, tuple[str, T.DataType]] = {f.name.lower(): (f.name, f.dataType) for f in df.schema.fields}

    def look(self, name: str) -> tuple[str, T.DataType]:
        found = self.columns.get(name.lower())
        if not found:
            near = get_close_matches(name.lower(), self.columns, 1)
            raise SyntaxFault(f"no column {name!r}" + (f"; did you mean {self.columns[near[0]][0]!r}?" if near else ""))
        return found

    def field(self, name: str, raw: bool = False) -> Typed:
        own, kind = self.look(name)
        c = F.col(f"`{own}`")
        if isinstance(kind, T.BooleanType):
            return c, "bool"
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (c if raw else B.null_if_nan(c)), "num"
        if isinstance(kind, T.NumericType):
            return c, "num"
        if isinstance(kind, T.ArrayType):
            return c, "list"
        if isinstance(kind, T.StringType):
            return B.blank_text(c), "text"
        return c.cast("string"), "text"


def number(v: Typed, s: Scope) -> Column:
    c, kind = v
    if kind == "num":
        return c.cast("double")
    return s.read(c) if kind == "text" else F.lit(None).cast("double")


def text(v: Typed) -> Column:
    c, kind = v
    if kind == "num":
        d = c.cast("double")
        return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))
    return c if kind == "text" else F.lit(None).cast("string")


def truth(v: Typed) -> Column:
    return F.coalesce(v[0], F.lit(False)) if v[1] == "bool" else F.lit(False)


def blank(v: Typed) -> Column:
    return F.size(F.coalesce(v[0], F.array())) == 0 if v[1] == "list" else v[0].isNull()


ORDER: dict[str, Callable[[Column, Column], Column]] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


def compared(o: str, a: Typed, b: Typed, s: Scope) -> Column:
    if o == "!=":
        return ~compared("=", a, b, s)
    if a[1] == b[1] == "num":
        plain = ORDER[o](a[0], b[0])
    elif "num" in (a[1], b[1]) or a[1] == b[1] == "text":
        x, y = number(a, s), number(b, s)
        plain = F.when(x.isNotNull() & y.isNotNull(), ORDER[o](x, y)).otherwise(ORDER[o](text(a), text(b)))
    elif a[1] == b[1] == "bool":
        plain = ORDER[o](a[0], b[0])
    else:
        plain = ORDER[o](a[0].cast("string"), b[0].cast("string"))
    if o != "=":
        return plain
    return F.when(blank(a) & blank(b), True).when(blank(a) | blank(b), False).otherwise(plain)


def arithmetic(o: str, x: Column, y: Column) -> Column:
    return B.finite({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[o]())


def date_part(c: Column, group: int) -> Column:
    return B.number(F.regexp_extract(c, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", group))


def least_of(cs: list[Column], of) -> Column:
    return of(*cs) if len(cs) > 1 else cs[0]


def call(name: str, nodes: tuple, s: Scope) -> Typed:
    args = [compiled(a, s) for a in nodes]
    n = [lambda i=i: number(args[i], s) for i in range(len(args))]
    t = [lambda i=i: text(args[i]) for i in range(len(args))]
    digits = nodes[1].args[0] if name == "round" and len(nodes) > 1 and nodes[1].kind == "number" else 0
    numeric = {
        "round": lambda: B.round_half_up(n[0](), int(digits)),
        "int": lambda: B.truncate(n[0]()),
        "floor": lambda: F.floor(n[0]()).cast("double"),
        "ceil": lambda: F.ceil(n[0]()).cast("double"),
        "abs": lambda: F.abs(n[0]()),
        "mod": lambda: B.floored_mod(n[0](), n[1]()),
        "bin": lambda: B.lower_edge(n[0](), n[1](), n[2]() if len(n) > 2 else F.lit(0.0)),
        "clamp": lambda: F.when(n[0]().isNotNull() & n[1]().isNotNull() & n[2]().isNotNull(), F.least(F.greatest(n[0](), n[1]()), n[2]())),
        "log": lambda: B.finite(F.when(n[0]() > 0, F.log(n[0]()))),
        "log10": lambda: B.finite(F.when(n[0]() > 0, F.log10(n[0]()))),
        "exp": lambda: B.finite(F.exp(n[0]())),
        "sqrt": lambda: F.when(n[0]() >= 0, F.sqrt(n[0]())),
        "pow": lambda: B.finite(F.pow(n[0](), n[1]())),
        "min": lambda: least_of([x() for x in n], F.least),
        "max": lambda: least_of([x() for x in n], F.greatest),
        "year": lambda: date_part(t[0](), 1),
        "month": lambda: date_part(t[0](), 2),
        "day": lambda: date_part(t[0](), 3),
        "len": lambda: F.char_length(t[0]()).cast("double"),
    }
    texts = {
        "upper": lambda: F.upper(t[0]()),
        "lower": lambda: F.lower(t[0]()),
        "trim": lambda: B.blank_text(F.trim(t[0]())),
        "left": lambda: B.blank_text(F.left(t[0](), n[1]().cast("int"))),
        "right": lambda: B.blank_text(F.right(t[0](), n[1]().cast("int"))),
        "substr": lambda: B.blank_text(F.substr(t[0](), n[1]().cast("int"), n[2]().cast("int")) if len(args) > 2 else F.substr(t[0](), n[1]().cast("int"))),
        "replace": lambda: B.blank_text(F.replace(t[0](), t[1](), F.coalesce(t[2](), F.lit("")))),
        "concat": lambda: B.text_join(*[x() for x in t]),
    }
    tests = {
        "isnum": lambda: n[0]().isNotNull(),
        "isnan": lambda: ~blank(args[0]) & n[0]().isNull(),
        "isblank": lambda: blank(args[0]),
        "isfilled": lambda: ~blank(args[0]),
    }
    for kind, table in (("num", numeric), ("text", texts), ("bool", tests)):
        if name in table:
            return table[name](), kind
    if name == "if":
        kind = joint(args[1:])
        return F.when(truth(args[0]), as_kind(args[1], kind, s)).otherwise(as_kind(args[2], kind, s)), kind
    kind = joint(args)
    if name == "coalesce":
        return F.coalesce(*[as_kind(a, kind, s) for a in args]), kind
    if name == "ifnum":
        return F.coalesce(number(args[0], s), number(args[1], s)), "num"
    if name == "nullif":
        return F.when(~compared("=", *args, s), args[0][0]), args[0][1]
    raise SyntaxFault(f"no function {name}")


def joint(args: list[Typed]) -> str:
    kinds = {k for _, k in args} - {"blank"}
    return kinds.pop() if len(kinds) == 1 else "text" if kinds else "blank"


def as_kind(v: Typed, kind: str, s: Scope) -> Column:
    if kind == "num":
        return number(v, s)
    return text(v) if kind == "text" else v[0]


def repeat(s: Scope, fn: str, name: str, inner: str | None = None) -> Typed:
    """Aggregates over a list of records."""
    c, kind = s.field(name)
    if kind != "list":
        raise SyntaxFault(f"{name} is not a repeat")
    items = F.coalesce(c, F.array().cast(s.look(name)[1]))
    if fn == "count":
        return F.size(items).cast("double"), "num"
    values = F.filter(F.transform(items, lambda x: x[inner].cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return {"total": total, "mean": F.try_divide(total, F.size(values)), "min": F.array_min(values), "max": F.array_max(values)}[fn], "num"


def compiled(node: Node, s: Scope, raw: bool = False) -> Typed:
    k, a = node.kind, node.args
    if k == "field":
        return s.field(a[0], raw)
    if k == "number":
        return F.lit(a[0]), "num"
    if k == "text":
        return (F.lit(a[0]), "text") if a[0] else (F.lit(None).cast("string"), "text")
    if k == "bool":
        return F.lit(a[0]), "bool"
    if k == "blank":
        return F.lit(None), "blank"
    if k == "negative":
        return -number(compiled(a[0], s), s), "num"
    if k == "arithmetic":
        return arithmetic(a[0], number(compiled(a[1], s), s), number(compiled(a[2], s), s)), "num"
    if k == "compare":
        return compared(a[0], compiled(a[1], s), compiled(a[2], s), s), "bool"
    if k == "and":
        return truth(compiled(a[0], s)) & truth(compiled(a[1], s)), "bool"
    if k == "or":
        return truth(compiled(a[0], s)) | truth(compiled(a[1], s)), "bool"
    if k == "not":
        return ~truth(compiled(a[0], s)), "bool"
    if k == "contains":
        whole, part = compiled(a[0], s), compiled(a[1], s)
        if whole[1] == "list":
            return F.coalesce(F.array_contains(whole[0], part[0]), F.lit(False)), "bool"
        return F.coalesce(F.contains(text(whole), text(part)), F.lit(False)), "bool"
    if k == "in":
        member = text(compiled(a[0], s))
        return F.coalesce(member.isin(*[text(compiled(x, s)) for x in a[1]]), F.lit(False)), "bool"
    if k == "matches":
        return F.coalesce(text(compiled(a[0], s)).rlike(a[1]), F.lit(False)), "bool"
    if k == "call":
        return call(a[0], a[1], s)
    if k == "repeat":
        return repeat(s, *a)
    raise SyntaxFault(f"unknown node {k}")


def pushed(node: Node, s: Scope) -> Column:
    """A condition that is true for the same rows, with plain comparisons of fields and numbers left to the scan."""
    if node.kind == "and":
        return pushed(node.args[0], s) & pushed(node.args[1], s)
    if node.kind == "compare" and node.args[0] in ORDER:
        o, a, b = node.args
        if {a.kind, b.kind} == {"field", "number"}:
            name = a if a.kind == "field" else b
            own, kind = s.look(name.args[0])
            if isinstance(kind, T.NumericType):
                plain = ORDER[o](compiled(a, s, True)[0], compiled(b, s, True)[0])
                # NaN sorts above every number
                above = isinstance(kind, (T.FloatType, T.DoubleType)) and ((o in (">", ">=")) == (a.kind == "field")) and o != "="
                return plain & ~F.isnan(F.col(f"`{own}`")) if above else plain
    return truth(compiled(node, s))


def to_column(df: DataFrame, source: str | Node, decimal: str = ".") -> Column:
    return compiled(parse(source) if isinstance(source, str) else source, Scope(df, decimal))[0]


def to_filter(df: DataFrame, source: str | Node, decimal: str = ".") -> Column:
    return pushed(parse(source) if isinstance(source, str) else source, Scope(df, decimal))


def where(df: DataFrame, source: str, decimal: str = ".") -> DataFrame:
    return df.where(to_filter(df, source, decimal))


def calc(df: DataFrame, formulas: dict[str, str], decimal: str = ".") -> DataFrame:
    """Adds columns one after the other; later formulas see earlier columns."""
    for name, source in formulas.items():
        df = df.withColumn(name, to_column(df, source, decimal))
    return df


def valid(df: DataFrame, target: str, constraint: str) -> Column:
    """A constraint holds if its target is blank or it is true."""
    s = Scope(df)
    return blank(s.field(target)) | truth(compiled(parse(constraint), s))


def validate(df: DataFrame, source: str) -> list[str]:
    """Problems of an expression: syntax, or names that the frame lacks."""
    try:
        node, s = parse(source), Scope(df)
    except SyntaxFault as e:
        return [str(e)]
    out = []
    for name in sorted(fields_of(node)):
        try:
            s.look(name)
        except SyntaxFault as e:
            out.append(str(e))
    return out
