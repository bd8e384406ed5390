"""Topic vectors, tags and their similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siltseek.functions import lexicon as L


def _vector(text: Column, flags: str, side: int) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.array(*[F.log1p(F.regexp_count(t, F.lit(flags + patterns[side]))) for patterns in L.TOPICS.values()])


def query_topics(text: Column) -> Column:
    """ln(1 + matches) of each topic in a question."""
    return _vector(text, "(?iU)", 0)


def code_topics(code: Column) -> Column:
    """ln(1 + matches) of each topic in code."""
    return _vector(code, "(?imdU)", 1)


def topic_map(vector: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in L.TOPIC_NAMES]), vector)


def top_tags(vector: Column, n: int = 3, least: float = 0.6) -> Column:
    """Names of the ``n`` strongest topics of at least ``least``; ties by topic order."""
    names = F.array(*[F.lit(x) for x in L.TOPIC_NAMES])
    rows = F.transform(vector, lambda x, i: F.struct((-x).alias("s"), i.alias("i"), F.element_at(names, i + 1).alias("name")))
    return F.transform(F.filter(F.slice(F.array_sort(rows), 1, n), lambda r: -r["s"] >= least), lambda r: r["name"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def topic_similarity(q: Column, d: Column) -> Column:
    """Cosine; a vector of zeros is similar to nothing."""
    one = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(q, d) / (one(q) * one(d))


def tagged_document(text: Column, tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.concat(F.lit("# topics: "), F.array_join(tags, ", "), F.lit("\n"), text)).otherwise(text)


def tagged_query(text: Column, tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.concat(F.lit("Topics: "), F.array_join(tags, ", "), F.lit(". "), text)).otherwise(text)
