"""Benchmark decontamination over a distributed positional inverted index.

A benchmark item's windows are its runs of 13 words (all its words if fewer).
Spark counts in the corpus the terms that windows hold; windows with a term that
never occurs are done. Each remaining window is looked up by its two rarest
terms: their postings (term, document, position) are the index, the lists are
shifted by the terms' offsets in the window and intersected, rarest first, and
what is left is compared word by word with the document.

Where more than `SHARED` windows have the same rarest term (all their words are
common), a posting isn't met with each of them: it gives the places where such a
window would begin, one for each offset, and the words that stand there are
looked up among the windows.

Proximity matches are places where a window's two rarest terms stand within `slop`
words of their distance in the window, in either order. Each posting is paired
with the postings that follow in its document within reach, so pairs grow with the
index and not with the windows.

Only postings of the looked-up terms are stored, so the index follows the
benchmark's rare words, not the corpus. Benchmark tables are broadcast only
after their size was measured, else joined by shuffle with hot keys dealt.

Defined cases: null text has no words; an item without words has no windows;
items of equal windows are all reported; a null item_id counts as item `null`;
repeated rows of documents give equal results each; no rows on either side give
no rows or no hits. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, small, table, text_key, written

WINDOW = 13
ANCHORS = 2
SHARED = 64
SLOP = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, -1), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (words joined by spaces), words, items holding it."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("words"))
    return rows.groupBy(F.array_join("words", " ").alias("window")).agg(F.first("words").alias("words"), F.array_sort(F.collect_set("item")).alias("items"))


def tokens(docs: DataFrame) -> DataFrame:
    """_id, _text, pos, term of every word."""
    return docs.select(*text_key(), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))


def anchors(docs: DataFrame, windows: DataFrame, count: int = ANCHORS) -> DataFrame:
    """window, size, off, term, rank, n: the rarest terms of windows all of whose terms occur."""
    terms = windows.select("window", F.size("words").alias("size"), F.posexplode("words").alias("off", "term"))
    vocabulary = written(terms.select("term").distinct(), "vocabulary")
    seen = lookup(tokens(docs), vocabulary, ["term"]).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = terms.join(written(seen, "frequencies"), "term", "left")
    own = Window.partitionBy("window")
    ranked = ranked.withColumn("absent", F.max(F.col("df").isNull().cast("int")).over(own)).filter("absent = 0")
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy("df", "off"))).filter(F.col("rank") <= count)
    return written(ranked.select("window", "size", "off", "term", "rank", F.least("size", F.lit(count)).alias("n")), "anchors")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given terms: term, _id, _text, pos, in order within its files."""
    found = lookup(tokens(docs), written(terms.select("term").distinct(), "terms"), ["term"])
    return written(found.select("term", "_id", "_text", "pos").sortWithinPartitions("term", "_id", "_text", "pos"), "postings")


class Index:
    """Windows, their rarest terms and these terms' postings."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = WINDOW, shared: int = SHARED) -> None:
        self.docs, self.size = docs, size
        self.windows = written(item_windows(items, size), "windows")
        self.lists = anchors(docs, self.windows)
        self.postings = postings(docs, self.lists)
        crowd = self.lists.filter("rank = 1").groupBy("term").agg(F.count(F.lit(1)).alias("sharing")).filter(F.col("sharing") > shared)
        crowd = self.lists.filter("rank = 1").join(crowd, "term").select("window")
        self.common = written(crowd, "common")

    def shifted(self, rank: int) -> DataFrame:
        """Where each window of rare words would begin, by the postings of its term of a rank."""
        own = self.lists.filter(F.col("rank") == rank).join(self.common, "window", "left_anti")
        found = lookup(self.postings, written(own, "lists"), ["term"])
        return found.select("_id", "_text", (F.col("pos") - F.col("off")).alias("start"), "window", "size", "n").filter("start >= 0")

    def places(self) -> DataFrame:
        """_id, _text, start, size: where a window may be, by intersection or, for those of common words, by their rarest."""
        found = written(self.shifted(1), "candidates")
        for rank in range(2, ANCHORS + 1):
            more = self.shifted(rank).select("_id", "_text", "start", "window")
            both = found.filter(F.col("n") >= rank).join(more, ["_id", "_text", "start", "window"], "left_semi")
            found = written(found.filter(F.col("n") < rank).unionByName(both), "candidates")
        offsets = self.lists.filter("rank = 1").join(self.common, "window", "left_semi").select("term", "off", "size").distinct()
        crowded = lookup(self.postings, written(offsets, "offsets"), ["term"]).select("_id", "_text", (F.col("pos") - F.col("off")).alias("start"), "size").filter("start >= 0")
        return found.select("_id", "_text", "start", "size").union(crowded)

    def occurrences(self) -> DataFrame:
        """_id, _text, start, end, items: every place in docs where a window occurs word by word."""
        places = written(self.places().groupBy("_id", "_text").agg(F.collect_set(F.struct("start", "size")).alias("places")), "places")
        texts = self.docs.select(*text_key(), "text").join(small(places), ["_id", "_text"]).withColumn("w", words_of(F.col("text")))
        said = F.transform("places", lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end"), F.array_join(F.slice("w", p["start"] + 1, p["size"]), " ").alias("window")))
        texts = texts.select("_id", "_text", F.explode(said).alias("s")).select("_id", "_text", "s.start", "s.end", "s.window")
        return lookup(texts, written(self.windows.select("window", "items"), "named"), ["window"]).select("_id", "_text", "start", "end", "items")

    def proximity(self, slop: int = SLOP) -> DataFrame:
        """_id, _text, pos (of the first of the two terms), items: places where a window's two rarest terms stand near each other."""
        of = lambda rank, name: self.lists.filter(F.col("rank") == rank).select("window", F.col("term").alias(name), F.col("off").alias(f"{name}_off"))
        pairs = of(1, "a").join(of(2, "b"), "window").join(self.windows.select("window", "items"), "window")
        both = [F.struct(F.col(x).alias("lo"), F.col(y).alias("hi"), (F.col(f"{y}_off") - F.col(f"{x}_off")).alias("want")) for x, y in ("ab", "ba")]
        pairs = pairs.select(F.explode(F.array(*both)).alias("p"), "items").groupBy("p.lo", "p.hi", "p.want").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        reach = self.size - 1 + slop
        lists = self.postings.groupBy("_id", "_text").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("p"))  # a document's own words
        after = lambda x, i: F.transform(
            F.filter(F.slice("p", i + 2, F.lit(reach)), lambda y: y["pos"] - x["pos"] <= reach),
            lambda y: F.struct(x["pos"].alias("pos"), x["term"].alias("lo"), y["term"].alias("hi"), (y["pos"] - x["pos"]).alias("gap")),
        )
        near = lists.select("_id", "_text", F.explode(F.flatten(F.transform("p", after))).alias("n")).select("_id", "_text", "n.*")
        near = lookup(near, written(pairs, "pairs"), ["lo", "hi"])
        return near.filter(F.abs(F.col("gap") - F.col("want")) <= slop).select("_id", "_text", "pos", "items")


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], size: int = WINDOW, slop: int | None = SLOP, shared: int = SHARED) -> DataFrame:
    """Columns `keep` of docs, n_words, n_hit, n_items, items and contaminated; n_near and near_items of proximity matches, exact ones among them (slop None: without these)."""
    index = Index(docs, items, size, shared)
    found = written(index.occurrences(), "occurrences")
    covered = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0).cast("long"), s["end"].cast("long") - F.greatest(a["reach"], s["start"].cast("long")))).alias("hit"),
            F.greatest(a["reach"], s["end"].cast("long")).alias("reach"),
        ),
        lambda a: a["hit"],
    )
    named = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    hits = found.groupBy("_id", "_text").agg(F.collect_set(F.struct("start", "end")).alias("places"), named("items").alias("items"))
    hits = hits.select("_id", "_text", covered.alias("n_hit"), "items")
    if slop is not None:
        near = written(index.proximity(slop), "near").groupBy("_id", "_text").agg(F.count_distinct("pos").alias("n_near"), named("items").alias("near_items"))
        hits = near.join(hits, ["_id", "_text"], "full")
    hits = written(hits, "hits")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *text_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(small(hits), ["_id", "_text"], "left")
    more = ["n_near", "near_items"] if slop is not None else []
    for c in {"n_hit", "n_near"} & {"n_hit", *more}:
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in {"items", "near_items"} & {"items", *more}:
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return rows.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *more,
    )


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    told = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", told("items").alias("items_sha256"), "contaminated", "n_near", F.size("near_items").cast("long").alias("n_near_items"), told("near_items").alias("near_items_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM v),
g AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
o AS (SELECT g.doc_id, g.i, g.k, v.item_id FROM g JOIN v USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM o) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
df AS (SELECT term, count(*) AS df FROM tok GROUP BY term),
vt AS (SELECT s, unnest(string_split(s, ' ')) AS term, generate_subscripts(string_split(s, ' '), 1) AS off FROM (SELECT DISTINCT s FROM v)),
r AS (
  SELECT s, term, off, row_number() OVER (PARTITION BY s ORDER BY df, off) AS r, bool_or(df IS NULL) OVER (PARTITION BY s) AS absent
  FROM vt LEFT JOIN df USING (term)),
p AS (
  SELECT DISTINCT a.term AS a, b.term AS b, b.off - a.off AS want, v.item_id::VARCHAR AS item
  FROM r a JOIN r b ON a.s = b.s AND a.r = 1 AND b.r = 2 AND NOT a.absent JOIN v ON v.s = a.s),
ix AS (SELECT doc_id, term, pos FROM tok WHERE term IN (SELECT a FROM p UNION SELECT b FROM p)),
n AS (
  SELECT x.doc_id, least(x.pos, y.pos) AS pos, p.item
  FROM p JOIN ix x ON x.term = p.a JOIN ix y ON y.term = p.b AND y.doc_id = x.doc_id
    AND y.pos - x.pos BETWEEN p.want - 5 AND p.want + 5 AND y.pos <> x.pos),
np AS (SELECT doc_id, count(DISTINCT pos) AS n_near FROM n GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM n) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated,
       coalesce(np.n_near, 0)::BIGINT AS n_near, coalesce(ni.n_items, 0)::BIGINT AS n_near_items, sha256(coalesce(ni.items, '')) AS near_items_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN np USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
