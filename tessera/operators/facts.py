"""A graph of facts as a table of triples (s, p, o, graph)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_variable(x: str | None) -> bool:
    return x is not None and x.startswith("?")


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, graph: str | None = None) -> DataFrame:
    """Triples that fit; None or a variable (``?x``) fits anything."""
    for c, v in (("s", s), ("p", p), ("o", o), ("graph", graph)):
        if v is not None and not is_variable(v):
            triples = triples.filter(F.col(c) == v)
    return triples


def ask(triples: DataFrame, **pattern: str) -> DataFrame:
    return match(triples, **pattern).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def bindings(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """A column for each variable of a pattern."""
    df = match(triples, *pattern)
    cols: dict[str, Column] = {}
    for c, v in zip("spo", pattern):
        if is_variable(v):
            if v[1:] in cols:
                df = df.filter(F.col(c) == cols[v[1:]])
            else:
                cols[v[1:]] = F.col(c)
    return df.select(*[c.alias(v) for v, c in cols.items()])


def graph_pattern(triples: DataFrame, patterns: Sequence[tuple[str, str, str]], optional: Sequence[tuple[str, str, str]] = (), where: Column | None = None) -> DataFrame:
    """Patterns joined on the variables they share; optional ones by left join."""
    out = None
    for pattern, how in [(p, "inner") for p in patterns] + [(p, "left") for p in optional]:
        b = bindings(triples, pattern)
        if out is None:
            out = b
        else:
            shared = [c for c in b.columns if c in out.columns]
            if not shared:
                raise ValueError(f"{pattern} shares no variable with what is before it")
            out = out.join(b, shared, how)
    return out if where is None else out.filter(where)


def delete_where(triples: DataFrame, **pattern: str) -> DataFrame:
    keep = F.lit(False)
    for c, v in pattern.items():
        keep = keep | ~F.col(c).eqNullSafe(F.lit(v))
    return triples.filter(keep)


def neighbourhood(triples: DataFrame, node: str, hops: int = 1) -> DataFrame:
    """The triples within one or two hops out of a node."""
    near = triples.filter(F.col("s") == node)
    if hops == 1:
        return near
    return near.unionByName(triples.join(near.select(F.col("o").alias("s")).distinct(), "s", "left_semi").select(*triples.columns)).distinct()


def to_triples(df: DataFrame, subject: Column, classes: Sequence[str], properties: Mapping[str, tuple[Column, str | None]], graph: str | None = None) -> DataFrame:
    """(s, p, o, datatype, graph): a type for each class and a triple for each property with a value."""
    t = lambda p, o, d: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(d).cast("string").alias("datatype"))
    made = F.array(*[t("type", F.lit(c), None) for c in classes], *[t(p, o, d) for p, (o, d) in properties.items()])
    return df.select(subject.alias("s"), F.explode(made).alias("t")).select("s", "t.p", "t.o", "t.datatype", F.lit(graph).cast("string").alias("graph")).filter("o IS NOT NULL AND s IS NOT NULL")


def template(text: str, columns: Sequence[str]) -> Column:
    """A subject from a template: each ``{column}`` is replaced by its URL-encoded value."""
    parts: list[Column] = []
    rest = text
    for c in columns:
        before, rest = rest.split("{" + c + "}", 1)
        parts += [F.lit(before), F.url_encode(F.col(c).cast("string"))]
    return F.concat(*parts, F.lit(rest))


def count_by_graph(triples: DataFrame) -> DataFrame:
    return triples.groupBy("graph").agg(F.count(F.lit(1)).alias("triples"))


def clear_graph(triples: DataFrame, graph: str) -> DataFrame:
    return triples.filter(~F.col("graph").eqNullSafe(F.lit(graph)))


def schema_triples(df: DataFrame, name: str) -> DataFrame:
    """Dataset, column and type facts of a table, and how many rows, nulls and (about) distinct values its columns have."""
    fact = lambda s, p, o: F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rows = [fact(name, "type", F.lit("Dataset")), fact(name, "rowCount", F.count(F.lit(1)).cast("string"))]
    for f in df.schema:
        at, c = f"{name}.{f.name}", F.col(f"`{f.name}`")
        rows += [fact(name, "hasColumn", F.lit(at)), fact(at, "dataType", F.lit(f.dataType.simpleString())), fact(at, "nullable", F.lit(str(f.nullable).lower()))]
        rows += [fact(at, "nullCount", F.count_if(c.isNull()).cast("string")), fact(at, "distinctCount", F.approx_count_distinct(c, 0.01).cast("string"))]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def refresh(triples: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """All facts of changed or deleted subjects (``changed.s``) replaced by ``new``."""
    return triples.join(changed.select("s").distinct(), "s", "left_anti").select(*triples.columns).unionByName(new)
