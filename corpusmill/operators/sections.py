"""Text lines to hierarchical sections, and their repair.

A document's lines are ordered by a window over the document; documents, not the
corpus, bound a task's sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import ancestor_ids, normal_id, parent_id, sort_key
from ..functions.text import blank, heading, lead_of, prepared, repaired_words, strip, title_of, without_junk
from .structure import reflowed


def lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, line_no, line."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def carried(rows: DataFrame, key: str, head: Column, order: str = "line_no") -> DataFrame:
    """rows with `head` of the last row that had one, and section: how many there were so far."""
    own = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("head", F.last(head, ignorenulls=True).over(own)).withColumn("section", F.sum(head.isNotNull().cast("long")).over(own))


def joined_next(rows: DataFrame, key: str, opens: Column, order: str = "line_no", by: str = " ") -> DataFrame:
    """A line that `opens` takes in the next one, which is dropped unless it opens too."""
    own = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_open", F.coalesce(opens, F.lit(False))).withColumn("_next", F.lead("line").over(own)).withColumn("_next_open", F.lead("_open").over(own)).withColumn("_taken", F.lag("_open", 1, False).over(own))
    takes = F.col("_open") & F.col("_next").isNotNull() & ~F.coalesce("_next_open", F.lit(True))
    line = F.when(takes, F.concat("line", F.lit(by), "_next")).otherwise(F.col("line"))
    return rows.withColumn("line", line).filter(~F.col("_taken") | F.col("_open")).drop("_open", "_next", "_next_open", "_taken")


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position, clause_id, title, body, sort_order of every numbered section."""
    rows = reflowed(docs, key, prepared(F.coalesce(F.col(text), F.lit(""))))
    rows = carried(rows.withColumn("own", heading(F.col("line"))), key, F.col("own")).filter("head is not null")
    said = F.when(F.col("own").isNotNull(), lead_of(F.col("own.title"))).otherwise(strip(F.col("line")))
    sections = rows.groupBy(key, "section").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("line_no", said.alias("said")))).alias("body"))
    body = F.array_join(F.filter(F.transform("body", lambda b: b["said"]), lambda s: s != ""), "\n\n")
    return sections.select(
        key,
        F.col("section").alias("position"),
        F.col("head.id").alias("clause_id"),
        title_of(F.col("head.title")).alias("title"),
        repaired_words(without_junk(body)).alias("body"),
        sort_key(F.col("head.id")).alias("sort_order"),
    )


def first_wins(sections: DataFrame, scope: list[str], order: str = "position") -> DataFrame:
    """One row a clause: the first one's title, its body or the first later one that isn't blank, the least sort_order, and n_warnings."""
    keyed = sections.withColumn("clause_id", normal_id(F.col("clause_id")))
    full = F.min_by(F.when(~blank(F.col("body")), F.col("body")), F.when(~blank(F.col("body")), F.col(order)))
    return keyed.groupBy(*scope, "clause_id").agg(
        F.min(order).alias(order),
        F.min_by("title", order).alias("title"),
        F.coalesce(full, F.lit("")).alias("body"),
        F.min("sort_order").alias("sort_order"),
        (F.count(F.lit(1)) - 1).alias("n_warnings"),
    )


def with_ancestors(sections: DataFrame, scope: list[str]) -> DataFrame:
    """Missing parents are added with empty bodies. The sections are read once: each also asks for its ancestors, and stands before those who ask for it."""
    own = F.struct("title", "body", "sort_order")
    none = F.lit(None).cast(sections.select(own.alias("own")).schema["own"].dataType)
    above = F.transform(ancestor_ids(F.col("clause_id")), lambda a: F.struct(a.alias("clause_id"), none.alias("own")))
    each = F.concat(F.array(F.struct("clause_id", own.alias("own"))), F.coalesce(above, F.array()))
    rows = sections.select(*scope, F.inline(each))
    first = F.row_number().over(Window.partitionBy(*scope, "clause_id").orderBy(F.col("own").isNull()))
    rows = rows.withColumn("_place", first).filter("own IS NOT NULL OR _place = 1")
    made = lambda c, given: F.when(F.col("own").isNull(), given).otherwise(F.col(f"own.{c}")).alias(c)
    return rows.select(*scope, "clause_id", made("title", F.concat(F.lit("Clause "), "clause_id")), made("body", F.lit("")), made("sort_order", sort_key(F.col("clause_id"))))


def rolled_up(sections: DataFrame, scope: list[str]) -> DataFrame:
    """An empty section gets its children's titles and bodies, one level only: a child without a body gives its title.

    The sections are read once: each goes to its own place and to its parent's.
    """
    said = F.concat(F.col("clause_id"), F.lit(" "), F.col("title"), F.lit("\n\n"), F.when(blank(F.col("body")), F.col("title")).otherwise(F.col("body")))
    own = F.struct(*[c for c in sections.columns if c not in (*scope, "clause_id")])
    child = F.struct("sort_order", F.col("clause_id").alias("id"), said.alias("said"))
    kinds = sections.select(own.alias("own"), child.alias("child")).schema
    none = lambda c: F.lit(None).cast(kinds[c].dataType).alias(c)
    places = F.array(F.struct("clause_id", own.alias("own"), none("child")), F.struct(parent_id(F.col("clause_id")).alias("clause_id"), none("own"), child.alias("child")))
    rows = sections.select(*scope, F.inline(places)).filter("own IS NOT NULL OR clause_id IS NOT NULL")
    met = rows.groupBy(*scope, "clause_id").agg(F.collect_list("own").alias("own"), F.collect_list("child").alias("below")).filter("size(own) > 0")
    told = F.when(F.size("below") > 0, F.array_join(F.transform(F.array_sort("below"), lambda s: s["said"]), "\n\n"))
    both = met.select(*scope, "clause_id", F.explode("own").alias("own"), "below").select(*scope, "clause_id", "own.*", F.when(blank(F.col("own.body")), told).alias("_below"))
    return both.withColumn("body", F.coalesce("_below", "body")).select(*sections.columns)


def merged(a: DataFrame, b: DataFrame, scope: list[str], good_title: Column) -> DataFrame:
    """Keyed union of two sets: the first good title, the longer body (the second set's on a tie), the least sort_order."""
    both = a.withColumn("_from", F.lit(0)).unionByName(b.withColumn("_from", F.lit(1)))
    return both.groupBy(*scope, "clause_id").agg(
        F.max_by("title", F.struct(good_title.cast("int"), -F.col("_from"))).alias("title"),
        F.max_by("body", F.struct(F.length("body"), "_from")).alias("body"),
        F.min("sort_order").alias("sort_order"),
    )


def coverage(sections: DataFrame, scope: list[str]) -> DataFrame:
    """n_sections, n_level3, n_chars and n_core of each set."""
    level3 = F.size(F.split("clause_id", r"\.")) >= 3
    core = F.coalesce(F.split_part("clause_id", F.lit("."), F.lit(1)).try_cast("int").between(0, 10), F.lit(False))
    return sections.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(level3).alias("n_level3"), F.sum(F.length(strip(F.col("body")))).alias("n_chars"), F.count_if(core).alias("n_core"))


def better(local: DataFrame, other: DataFrame, ratio: float = 0.70) -> Column:
    """Whether the other of two one-row coverages (aliased l and o) should be taken: far more third levels at half the text, or as much text."""
    deeper = (F.col("o.n_level3") >= F.col("l.n_level3") + 5) & (F.col("o.n_chars") >= F.floor(F.col("l.n_chars") * 0.55))
    return deeper | ((F.col("o.n_sections") >= F.col("l.n_sections")) & (F.col("o.n_chars") >= F.col("l.n_chars") * ratio))


def choose(local: DataFrame, other: DataFrame, ratio: float = 0.70) -> DataFrame:
    """One of two whole sets, by their coverage."""
    verdict = coverage(local, []).alias("l").crossJoin(coverage(other, []).alias("o")).select(better(local, other, ratio).alias("_o"))
    tagged = local.withColumn("_from", F.lit(False)).unionByName(other.withColumn("_from", F.lit(True)))
    return tagged.join(F.broadcast(verdict), F.col("_from") == F.coalesce("_o", F.lit(False))).drop("_from", "_o")
