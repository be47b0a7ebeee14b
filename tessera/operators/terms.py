"""Ontology terms for fields, by seven strategies whose findings are weighed against each other.

Fields and terms never meet in a cross join: manual and exact names by equality, words by :func:`.match.tf_cosine`, edits by
shared segments, parts of names by equality with the substrings of the other, vectors block by block."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import _segment_pairs, levenshtein_similarity, tf_cosine, vector_top_k
from .profile import present, unpivot
from .relational import top_k_per_group

# Weights of the strategies; a manual mapping goes before all.
WEIGHTS = {"pattern": 1.5, "semantic": 1.2, "statistical": 1.0, "lexical": 0.8, "registry": 1.1, "heuristic": 0.6}

# Terms of values that fit a pattern (pattern, term, confidence), and the share of values that must fit.
VALUE_TERMS = [
    (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "http://schema.org/email", 0.95),
    (r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,5}[-\s\.]?[0-9]{1,5}$", "http://schema.org/telephone", 0.92),
    (r"^https?://[^\s/$.?#].[^\s]*$", "http://schema.org/url", 0.90),
    (r"^\d{5}(-\d{4})?$", "http://schema.org/postalCode", 0.88),
    (r"^\d{4}-\d{2}-\d{2}$", "http://schema.org/Date", 0.87),
    (r"^[$£€¥]\s?\d+\.?\d*$", "http://schema.org/price", 0.85),
]
VALUE_SHARE = 0.8

# Words in names (words, term, confidence, whether a word inside the name does not count).
NAME_TERMS = [
    ("email emailaddress mail", "http://schema.org/email", 0.72, False),
    ("name fullname", "http://schema.org/name", 0.68, True),
    ("firstname givenname fname", "http://schema.org/givenName", 0.70, False),
    ("lastname surname familyname lname", "http://schema.org/familyName", 0.70, False),
    ("phone telephone phonenumber tel mobile", "http://schema.org/telephone", 0.71, False),
    ("address streetaddress street", "http://schema.org/streetAddress", 0.68, False),
    ("city", "http://schema.org/addressLocality", 0.67, True),
    ("state province region", "http://schema.org/addressRegion", 0.66, True),
    ("zip zipcode postalcode postcode", "http://schema.org/postalCode", 0.70, False),
    ("country", "http://schema.org/addressCountry", 0.67, True),
    ("price cost amount", "http://schema.org/price", 0.65, True),
    ("date datetime", "http://schema.org/Date", 0.66, False),
    ("createdat created", "http://schema.org/dateCreated", 0.68, False),
    ("updatedat modified lastmodified", "http://schema.org/dateModified", 0.68, False),
    ("identifier", "http://schema.org/identifier", 0.67, False),
    ("url website webpage link", "http://schema.org/url", 0.69, False),
    ("description desc summary", "http://schema.org/description", 0.65, False),
]
PUBLIC = "schema.org"


def plain_name(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def name_words(c: Column) -> Column:
    """The words of a name, cut at capitals and at all but letters and digits, in lower case; single characters are none."""
    apart = F.lower(F.regexp_replace(c, r"(\p{Lu})", " $1"))
    return F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 1)


def _vectors(df: DataFrame, key: str, words: Column) -> DataFrame:
    counts = df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(key, "term", (F.col("n") / F.col("norm")).alias("weight"))


def by_name(fields: DataFrame) -> DataFrame:
    """Heuristic: words that a name is, has, ends or begins with, or (where that counts) has inside."""
    whole, words = plain_name(F.col("field")), F.filter(F.split(F.lower("field"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    found = []
    for text, term, sure, outer in NAME_TERMS:
        bonus = None
        for word in text.split():
            hit = [(whole == word) | F.array_contains(words, word), F.endswith(whole, F.lit(word)), F.startswith(whole, F.lit(word))]
            for test, more in zip(hit + ([] if outer else [F.contains(whole, F.lit(word))]), (0.03, 0.02, 0.01, 0.0)):
                bonus = F.when(test, more) if bonus is None else bonus.when(test, more)
        found.append(F.when(bonus.isNotNull(), F.struct(F.lit(term).alias("term"), F.least(bonus + sure, F.lit(0.75)).alias("confidence"))))
    hits = fields.select("field", F.explode(F.array_compact(F.array(*found))).alias("h"))
    return hits.select("field", "h.term", F.lit("heuristic").alias("strategy"), "h.confidence")


def by_values(values: DataFrame, fields: list[str]) -> DataFrame:
    """Pattern: what at least VALUE_SHARE of a column's values look like, by one aggregation over all columns."""
    v = unpivot(values, fields).filter(present(F.col("value"))).withColumn("value", F.trim("value"))
    shares = v.groupBy("column").agg(*[(F.count_if(F.col("value").rlike(p)) / F.count(F.lit(1))).alias(f"s{i}") for i, (p, _, _) in enumerate(VALUE_TERMS)])
    found = [F.when(F.col(f"s{i}") >= VALUE_SHARE, F.struct(F.lit(t).alias("term"), F.lit(c).alias("confidence"))) for i, (_, t, c) in enumerate(VALUE_TERMS)]
    hits = shares.select(F.col("column").alias("field"), F.explode(F.array_compact(F.array(*found))).alias("h"))
    return hits.select("field", "h.term", F.lit("pattern").alias("strategy"), "h.confidence")


def by_words(fields: DataFrame, terms: DataFrame, least: float = 0.3) -> DataFrame:
    """(field, term, cosine) of the words of a name and those of a term's label, synonyms and description."""
    label = F.concat(name_words(F.coalesce("label", F.lit(""))), F.flatten(F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), name_words)), name_words(F.coalesce("description", F.lit(""))))
    of_terms = _vectors(terms.select(F.col("term").alias("uri"), label.alias("words")), "uri", F.col("words"))
    return tf_cosine(_vectors(fields, "field", name_words(F.col("field"))), of_terms, "field", "uri", least).select("field", F.col("uri").alias("term"), "cosine")


def by_edits(fields: DataFrame, terms: DataFrame, least: float = 0.6) -> DataFrame:
    """(field, term, similarity) of names and labels by Levenshtein similarity. Names meet labels by shared segments only."""
    names = fields.select("field", plain_name(F.col("field")).alias("text")).filter("text != ''")
    labels = terms.select("term", F.lower("label").alias("text")).filter("text != ''")
    side = lambda df, s: df.select(F.lit("").alias("block"), "text", F.concat(F.lit(s), "text").alias("key")).distinct()
    met = _segment_pairs(side(names, "f").unionByName(side(labels, "t")), least).filter(F.substring("a", 1, 1) != F.substring("b", 1, 1)).select("left", "right").distinct()
    equal = names.select(F.col("text").alias("left")).join(labels.select(F.col("text").alias("right")), F.col("left") == F.col("right")).distinct()
    near = met.unionByName(equal).distinct().withColumn("similarity", levenshtein_similarity(F.col("left"), F.col("right"))).filter(F.col("similarity") >= least - 1e-12)
    return near.join(names, F.col("left") == names["text"]).drop("text").join(labels, F.col("right") == labels["text"]).select("field", "term", "similarity")


def by_parts(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, term) where the name holds the label or the label the name: one side's substrings (the square of a name's
    length) are keys of an equality join."""
    names = fields.select("field", plain_name(F.col("field")).alias("text")).filter("text != ''")
    labels = terms.select("term", F.lower("label").alias("text")).filter("text != ''")

    def parts(df: DataFrame) -> DataFrame:
        starts = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.char_length("text"))))
        lengths = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.char_length("text") - F.col("i") + 1)))
        return lengths.withColumn("text", F.substring("text", F.col("i"), F.col("n"))).drop("i", "n").distinct()

    return parts(names).join(labels, "text").select("field", "term").unionByName(names.join(parts(labels), "text").select("field", "term")).distinct()


def strategy_matches(fields: DataFrame, terms: DataFrame, values: DataFrame | None = None, field_vectors: DataFrame | None = None, term_vectors: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """(field, term, strategy, confidence): what each strategy finds for ``fields`` (field) among ``terms`` (term, label and,
    if known, synonyms, description, namespace).

    ``values`` is a table whose columns are fields (pattern); vectors are (field, vector) and (term, vector) (semantic);
    ``manual`` is (field, term). Null and empty names find nothing; repeated fields and terms count once."""
    kinds = {"synonyms": "array<string>", "description": "string", "namespace": "string"}
    fields = fields.select("field").filter("field IS NOT NULL").distinct()
    terms = terms.select("term", "label", *[F.col(c) if c in terms.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).filter("term IS NOT NULL").dropDuplicates()
    words = by_words(fields, terms).groupBy("field", "term").agg(F.max("cosine").alias("cosine"))
    edits = by_edits(fields, terms).groupBy("field", "term").agg(F.max("similarity").alias("similarity"))
    row = lambda df, name, sure: df.select("field", "term", F.lit(name).alias("strategy"), sure.alias("confidence"))
    out = by_name(fields)
    out = out.unionByName(row(words, "statistical", 0.70 + (F.col("cosine") - 0.3) / 0.7 * 0.15))
    out = out.unionByName(row(edits, "lexical", 0.65 + (F.col("similarity") - 0.6) * 0.375))
    own = terms.filter(~F.startswith(F.coalesce("namespace", F.lit("")), F.lit(PUBLIC))).select("term").distinct()
    parts = by_parts(fields, terms).withColumn("part", F.lit(True))
    registry = words.join(edits, ["field", "term"], "full").join(parts, ["field", "term"], "full").join(own, "term", "left_semi")
    sure = F.when(F.col("similarity") >= 1, 0.90).when(F.col("cosine") >= 0.4 - 1e-12, 0.75 + (F.col("cosine") - 0.4) * 0.25).when(F.col("similarity") >= 0.7 - 1e-12, 0.75 + (F.col("similarity") - 0.7) * 0.5).when(F.col("part"), 0.76)
    out = out.unionByName(row(registry, "registry", sure).filter("confidence IS NOT NULL"))
    if values is not None:
        out = out.unionByName(by_values(values, values.columns))
    if field_vectors is not None and term_vectors is not None:
        keyed = lambda df, c: df.select(F.concat(F.lit(f"{c}:"), c).alias("key"), "vector")
        near = vector_top_k(keyed(field_vectors, "field"), keyed(term_vectors, "term"), "key", "vector", 2**31 - 1, 0.7)
        named = near.select(F.expr("substring(query, 7)").alias("field"), F.expr("substring(key, 6)").alias("term"), "similarity")
        out = out.unionByName(row(named, "semantic", 0.80 + (F.col("similarity") - 0.7) * 0.33))
    if manual is not None:
        out = out.unionByName(row(manual.select("field", "term").distinct(), "manual", F.lit(1.0)))
    return out


def map_to_terms(matches: DataFrame, least: float = 0.0, k: int = 5, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """(field, term, confidence, strategies, rank): the ``k`` best terms of each field from :func:`strategy_matches`, by the
    weighted mean of what the strategies found, ties to the smaller term. A field with manual terms has only these."""
    fixed = matches.filter("strategy = 'manual'").select("field").distinct()
    live = matches.filter("strategy = 'manual'").unionByName(matches.filter("strategy != 'manual'").join(fixed, "field", "left_anti"))
    weight = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(1.0))
    scored = live.groupBy("field", "term").agg((F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"), F.array_sort(F.collect_set("strategy")).alias("strategies"))
    return top_k_per_group(scored.filter(F.col("confidence") >= least), ["field"], [F.desc(F.round("confidence", 9)), F.col("term")], k)
