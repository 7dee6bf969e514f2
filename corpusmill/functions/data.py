"""JSON, vectors and clamps, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def merged_json(base: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects; the patch's keys win. Values are texts."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_zip_with(read(base), read(patch), lambda _, a, b: F.coalesce(b, a))


def tolerant_map(raw: Column) -> Column:
    """The object's texts; an empty map for anything that isn't an object."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def has_key(raw: Column, key: str) -> Column:
    """Whether a JSON object has a value other than null for a key."""
    return F.get_json_object(raw, f"$.{key}").isNotNull()


def first_object(text: Column) -> Column:
    """From the first brace to the last, null unless that is valid JSON; a truncated reply isn't salvaged."""
    span = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(span).isNotNull(), span)


def usage(raw: Column) -> Column:
    """prompt, completion and total tokens of a reply, under either naming."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(raw, f"$.usage.{p}").try_cast("long") for p in paths], F.lit(0).cast("long"))
    prompt, completion = first("prompt_tokens", "input_tokens"), first("completion_tokens", "output_tokens")
    total = F.get_json_object(raw, "$.usage.total_tokens").try_cast("long")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.coalesce(total, prompt + completion).alias("total_tokens"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))  # a length in the inner function would be taken for each value


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is zero."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def is_failed_embedding(v: Column) -> Column:
    """An embedding whose first eight values are zero stands for a failed call."""
    return F.forall(F.slice(v, 1, 8), lambda x: x == 0)


def score(similarity: Column) -> Column:
    """1 to 10, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(similarity * 10).cast("int"))


def relevance(similarity: Column) -> Column:
    """Percent between 50 and 95, rounded half to even."""
    return F.least(F.lit(95), F.greatest(F.lit(50), F.bround(similarity * 100).cast("int")))


def keyword_relevance(flag: Column) -> Column:
    return F.least(F.lit(95), 50 + flag * 8)
