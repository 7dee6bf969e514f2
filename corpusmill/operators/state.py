"""Maintenance of keyed tables as snapshots: each function takes the old rows and returns the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.data import merged_json
from ..functions.ids import sort_key


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by `order`: an aggregate, so a key's rows are combined before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*[c if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones of the same key; keys of `new` are unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only `columns` are taken over, where they aren't null; the others of an old row stay (ids, creation times, embeddings)."""
    both = old.alias("o").join(new.alias("n"), keys, "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in columns else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only the new rows whose key is free; keys of `new` are unique."""
    return new.join(old.select(*keys), keys, "left_anti")


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All old rows of the scopes that `new` has are dropped."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def purge(old: DataFrame, gone: Column) -> DataFrame:
    return old.filter(~F.coalesce(gone, F.lit(False)))


def split_deleted(old: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and those deleted."""
    return purge(old, gone), old.filter(gone)


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def purge_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Without the rows of the listed keys."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def update_where(old: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that `hit` holds for get new values; null is no hit."""
    return old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def rescaled(sections: DataFrame, below: int = 1_000_000) -> DataFrame:
    """Sort orders of the older, smaller scale are computed anew; running it again changes nothing."""
    return update_where(sections, F.col("sort_order") < below, {"sort_order": sort_key(F.col("clause_id"))})


def seeded(old: DataFrame, seed: DataFrame, keys: list[str], kept: tuple[str, ...] = ("source",)) -> DataFrame:
    """A seed's rows overwrite all but the `kept` columns of old ones; loading it again changes nothing."""
    return upsert_columns(old, seed, keys, [c for c in old.columns if c not in (*keys, *kept)])


def with_defaults(rows: DataFrame) -> DataFrame:
    """created_at and updated_at, now where they are missing."""
    return with_column(with_column(rows, "created_at", F.current_timestamp()), "updated_at", F.current_timestamp())


def merge_patch(df: DataFrame, column: str, patch: Column) -> DataFrame:
    return df.withColumn(column, F.to_json(merged_json(F.col(column), patch)))


def publish(versions: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New bodies become the published next version of their key, older versions of it are withdrawn."""
    last = versions.groupBy(*keys).agg(F.max("version").alias("_v"))
    told = new.join(last, keys, "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).withColumn("is_published", F.lit(True)).drop("_v")
    again = versions.join(new.select(*keys, F.lit(True).alias("_new")).distinct(), keys, "left")
    again = again.withColumn("is_published", F.col("is_published") & F.col("_new").isNull()).drop("_new")
    return again.unionByName(told.select(*versions.columns))


def audit(changes: DataFrame, user: Column, action: Column, entity: Column, before: Column, after: Column) -> DataFrame:
    """user_id (null unless a UUID), action, entity_id, before_json, after_json."""
    uuid = F.when(user.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), user)
    return changes.select(uuid.alias("user_id"), action.alias("action"), entity.alias("entity_id"), F.to_json(before).alias("before_json"), F.to_json(after).alias("after_json"))


def with_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    """Schema evolution: a missing column or missing values get the default."""
    return df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)


def delete_standard(clauses: DataFrame, chunks: DataFrame, documents: DataFrame, standard: str, language: str | None = None, scoped: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three tables without a standard (or one language of it), and the counts removed.

    Unless `scoped`, corpus documents of the standard go even if only one language was asked for.
    """
    of = lambda s, lang: (F.col(s) == standard) & (F.lit(True) if language is None else F.col(lang) == language)
    doc_gone = F.array_contains("standards", standard) & ((F.col("language") == language) if scoped and language else F.lit(True))
    each = [split_deleted(clauses, of("standard", "language")), split_deleted(chunks, of("metadata.standard", "metadata.language")), split_deleted(documents, doc_gone)]
    counts = [gone.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name, (_, gone) in zip(("clauses", "chunks", "documents"), each, strict=True)]
    return each[0][0], each[1][0], each[2][0], counts[0].union(counts[1]).union(counts[2])
