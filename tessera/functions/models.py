"""User functions and models over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register_function(spark: SparkSession, name: str, f: Callable[..., pd.Series], result: str) -> None:
    """A vectorised user function, by name in SQL."""
    spark.udf.register(name, F.pandas_udf(f, result))


def text_function(f: Callable[[str], str], limit: int = 1 << 20) -> Callable[[Column], Column]:
    """User code from text to text: nulls stay, an error or a result over ``limit`` characters gives null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            try:
                out = f(x)
            except Exception:  # noqa: BLE001 the row, not the job, fails
                return None
            return out if isinstance(out, str) and len(out) <= limit else None

        return s.map(one)

    return run


# Patterns of the heuristic rules.
HEURISTICS = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "us_phone": r"^(\+1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}$", "iso_date": r"^\d{4}-\d{2}-\d{2}$"}


def heuristic(rule: dict) -> Column:
    """(confidence, decision) of a row under a rule: its confidence if it holds, else 1 less it; accept from 0.5. What looks at
    other rows (``unique``) is :func:`heuristics`."""
    c, kind = F.col(rule["field"]), rule["kind"]
    if kind == "unique":
        raise ValueError("unique needs the table: use heuristics")
    text = c.cast("string")
    if kind == "not_null":
        ok = c.isNotNull()
    elif kind == "range":
        ok = c.cast("double").between(rule["min"], rule["max"])
    elif kind == "length":
        ok = F.char_length(text).between(rule["min"], rule["max"])
    else:
        ok = text.rlike(HEURISTICS.get(kind) or rule["pattern"])
    return _decision(ok, rule)


def _decision(ok: Column, rule: dict) -> Column:
    confidence = F.when(F.coalesce(ok, F.lit(False)), rule.get("confidence", 0.9)).otherwise(1 - rule.get("confidence", 0.9))
    return F.struct(confidence.alias("confidence"), F.when(confidence >= 0.5, "accept").otherwise("reject").alias("decision"))


def heuristics(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``df`` with a struct (confidence, decision) for each named rule. For ``unique`` values are counted with partial sums, and
    only rows of values that occur once look them up: a value that fills the table is grouped to one row and joins nothing.
    Null is no unique value."""
    out = df
    for name, rule in rules.items():
        if rule["kind"] != "unique":
            out = out.withColumn(name, heuristic(rule))
            continue
        value = F.col(rule["field"])
        once = df.filter(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("_v", F.lit(True).alias("_once"))
        out = out.join(once, value == F.col("_v"), "left").withColumn(name, _decision(F.col("_once"), rule)).drop("_v", "_once")
    return out


def predict(df: DataFrame, features: Sequence[str], model: Callable[[np.ndarray], np.ndarray], least: float = 0.5, fallback: str = "manual_review", names: Sequence[str] = ("prediction", "confidence", "decision")) -> DataFrame:
    """Scores rows by a model from a matrix to (label, confidence) columns; below ``least`` the fallback decides. The model is
    broadcast, batches are Arrow's."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label double, confidence double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            out = np.asarray(shared.value(np.column_stack([c.to_numpy(float) for c in cols])), float).reshape(len(cols[0]), 2)
            yield pd.DataFrame({"label": out[:, 0], "confidence": out[:, 1]})

    scored = df.withColumn("_s", score(*[F.col(f).cast("double") for f in features]))
    decision = F.when(F.col("_s.confidence") >= least, "accept").otherwise(fallback)
    return scored.withColumns({names[0]: F.col("_s.label"), names[1]: F.col("_s.confidence"), names[2]: decision}).drop("_s")


def resolve_by(df: DataFrame, by: Sequence[str], f: Callable[[pd.DataFrame], str | None]) -> DataFrame:
    """A user's own conflict rule over the values of each group (entity, field), which are few.

    Groups lie one after another in sorted partitions, and the rule runs over slices of Arrow's batches: many small groups
    cost a call of the rule each, not a batch each. Whole numbers keep their type but in groups with nulls."""
    kinds = {c: df.schema[c].dataType for c in df.columns}
    whole = [c for c in df.columns if isinstance(kinds[c], T.IntegralType)]
    # keys as texts, which keep nulls and all digits; what a text can't give back keeps a batch a group
    if not all(isinstance(kinds[c], (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.DecimalType)) for c in by):
        return df.groupBy(*by).applyInPandas(lambda key, pdf: pd.DataFrame([(*key, f(pdf))]), ", ".join(f"{c} {kinds[c].simpleString()}" for c in by) + ", value string")
    keys, nulls = [f"_key{i}" for i in range(len(by))], {c: f"_null{i}" for i, c in enumerate(whole)}
    filled = [F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) if c in nulls else F.col(c) for c in df.columns]
    rows = df.select(*filled, *[F.col(c).isNull().alias(n) for c, n in nulls.items()], *[F.col(c).cast("string").alias(k) for c, k in zip(by, keys)])

    def values(pdf: pd.DataFrame, starts: Sequence[int], ends: Sequence[int]) -> pd.DataFrame:
        data, none, named = pdf[df_columns], {c: pdf[n].to_numpy(bool) for c, n in nulls.items()}, [pdf[k].to_numpy(object) for k in keys]
        found = []
        for a, b in zip(starts, ends):
            one = data.iloc[a:b]
            one.index = pd.RangeIndex(b - a)
            lost = {c: one[c].mask(n[a:b]) for c, n in none.items() if n[a:b].any()}
            found.append((*[k[a] for k in named], f(one.assign(**lost) if lost else one)))
        return pd.DataFrame(found, columns=[*keys, "value"], dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = np.zeros(len(pdf), bool)
            for k in keys:
                c = pd.factorize(pdf[k])[0]  # null is -1
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist()] if len(pdf) else []
            yield values(pdf, starts[:-1], starts[1:])
            held = pdf.iloc[starts[-1] :] if starts else None
        if held is not None:
            yield values(held, [0], [len(held)])

    df_columns = list(df.columns)
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", value string")
    return found.select(*[F.col(k).cast(kinds[c]).alias(c) for c, k in zip(by, keys)], "value")


def embed(df: DataFrame, column: str, size: int = 64, encoder: Callable[[list[str]], np.ndarray] | None = None, to: str = "vector") -> DataFrame:
    """A vector for each text by a user's encoder; by default hashed term counts scaled to length one, without Python."""
    if encoder is None:
        let = lambda x, then: F.transform(F.array(x), then)[0]  # noqa: E731 one evaluation a row: a projection's columns are put in where they are used
        words = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
        counts = lambda found: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(found, lambda s: s == i)).cast("double"))
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        scaled = lambda c: let(norm(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c))
        return df.withColumn(to, let(slots, lambda s: let(counts(s), scaled)))
    shared = df.sparkSession.sparkContext.broadcast(encoder)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.asarray(shared.value(s.fillna("").tolist()), float)))

    return df.withColumn(to, run(column))
