"""Identifiers of standards, collections, files and hierarchical sections, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEGACY_COLLECTION = "iso-standards"
MAX_LEVELS, LEVEL_BASE = 5, 100
ID_TOKEN = r"^\d{1,2}(?:\.\d{1,2}){0,4}[.)]?$"


def standard_id(name: Column) -> Column:
    """Upper case without spaces and hyphens; one form for every table."""
    return F.translate(F.upper(name), " -", "")


def collection_id(name: Column) -> Column:
    return F.concat(F.lit(f"{LEGACY_COLLECTION}-"), standard_id(name))


def id_parts(clause: Column) -> Column:
    return F.filter(F.split(clause, r"\."), lambda p: p != "")


def normal_id(clause: Column) -> Column:
    """Numeric parts without leading zeros, empty parts dropped; other ids only trimmed."""
    trimmed = F.regexp_replace(clause, r"^\s+|\s+$", "")
    parts = id_parts(trimmed)
    numeric = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^\d+$"))
    plain = F.transform(parts, lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))
    return F.when(numeric, F.array_join(plain, ".")).otherwise(trimmed)


def sort_key(clause: Column) -> Column:
    """The first five numeric parts, each at most 99, as digits of a base-100 number."""
    numbers = F.transform(F.filter(F.split(clause, r"\."), lambda p: p.rlike(r"^\d+$")), lambda p: F.least(F.lit(99), F.coalesce(p.try_cast("long"), F.lit(99))))
    digits = F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), MAX_LEVELS)), 1, MAX_LEVELS)
    return F.when(F.size(numbers) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * LEVEL_BASE + d))


def natural_key(clause: Column) -> Column:
    """All numeric parts as an array, which orders ids of any depth."""
    return F.transform(F.filter(F.split(clause, r"\."), lambda p: p.rlike(r"^\d+$")), lambda p: p.try_cast("decimal(38,0)"))


def sortable(clause: Column) -> Column:
    """A string that sorts as the numeric parts do, however many and however large: each part's length, in three digits, before it."""
    parts = F.transform(F.filter(F.split(clause, r"\."), lambda p: p.rlike(r"^\d+$")), lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lpad(F.length(p).cast("string"), 3, "0"), p)), "")


def depth(clause: Column) -> Column:
    return F.size(id_parts(clause))


def parent_id(clause: Column) -> Column:
    """Null for a top-level id."""
    parts = id_parts(clause)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))


def ancestor_ids(clause: Column) -> Column:
    """From the top level down to the parent."""
    parts = id_parts(clause)
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def top_part(clause: Column) -> Column:
    return F.split_part(clause, F.lit("."), F.lit(1)).try_cast("int")


def is_core(clause: Column) -> Column:
    """Introduction (0) and the normative sections 1 to 10."""
    return F.coalesce(top_part(clause).between(0, 10), F.lit(False))


def source_path(corpus: Column, name: Column, clause: Column) -> Column:
    return F.concat(F.lit("uploads/"), corpus, F.lit("/"), name, F.lit("#"), clause)


def file_language(name: Column, default: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(lower.rlike(r"-he|_he\.|\.he\.md"), "he")
        .when(lower.rlike(r"-en|_en\."), "en")
        .otherwise(default)
    )


def file_standard(name: Column, standards: Column) -> Column:
    """The first of the manifest's standards that the upper-cased stem holds, else empty."""
    stem = F.upper(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.coalesce(F.get(F.filter(standards, lambda s: F.contains(stem, F.upper(s))), F.lit(0)), F.lit(""))


def edition(name: Column) -> Column:
    return F.regexp_extract(name, r"(20\d{2})", 1)


def file_kind(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def content_type(name: Column) -> Column:
    kind = file_kind(name)
    return (
        F.when(kind == "pdf", "application/pdf")
        .when(kind == "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(kind == "doc", "application/msword")
        .when(kind == "json", "application/json")
        .when(kind.isin("txt", "md"), "text/plain")
        .otherwise("application/octet-stream")
    )


def safe_name(name: Column, length: int = 40) -> Column:
    return F.substring(F.replace(name, F.lit(" "), F.lit("_")), 1, length)


def language_code(name: Column) -> Column:
    lower = F.lower(F.trim(name))
    return F.when(lower.startswith("he"), "he").when(lower.startswith("ar"), "ar").when(lower.startswith("en"), "en").otherwise(lower)


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("true", "1", "yes", "on")


def is_admin(roles: Column, admins: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(roles, F.array(*[F.lit(r) for r in admins])), F.lit(False))


def iso_time(ts: Column) -> Column:
    """UTC if the session is; microseconds only where there are any."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def display_name(name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.split_part(email, F.lit("@"), F.lit(1)))
