"""Extracted lines to logical lines, nested headings to sections of their own, titles checked and repaired.

Everything is windows over a document's or a section's lines and joins with small
tables of known titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import depth, is_core, normal_id, sort_key
from ..functions.text import (
    BARE_ID,
    HEBREW,
    JUNK_LINE,
    bad_title,
    blank,
    compatible_title,
    heading,
    let,
    repaired_words,
    strip,
    title_like,
    without_junk,
)

DOTS = r"^[.\s…·‧]+$"
MARKED = r"^#{1,6}\s+(.*\S)\s*$"
SENTENCE_END = r"(?<=[.!?…])\s+"
WRAPPED_CHARS = 48
#: Code points that are kept of a paragraph under way: more than any title has.
TAIL = 200


def _named(id_: Column, title: Column) -> Column:
    """The heading line of an id and a title that stood on a line of its own; null if it isn't one."""
    line = F.concat(id_, F.lit(" "), title)
    return let(line, lambda whole: F.when((title != "") & title_like(title) & heading(whole).isNotNull(), whole))


def _undotted(id_: Column) -> Column:
    return F.regexp_replace(id_, r"^\.+|\.+$", "")


def _line(raw: Column) -> Column:
    """struct(kind, line) of a raw line."""

    def kind(line: Column) -> Column:
        marked = F.regexp_extract(line, MARKED, 1)
        mark = let(marked, lambda m: F.when((m != "") & heading(m).isNull(), m))
        told = F.when(heading(line).isNotNull(), "head").when(line.rlike(BARE_ID), "id").when(line.rlike(JUNK_LINE), "junk").otherwise("text")
        as_mark = lambda m: F.when(m.isNotNull(), F.struct(F.lit("mark").alias("kind"), m.alias("line"))).otherwise(F.struct(told.alias("kind"), line.alias("line")))
        return F.when(line == "", F.struct(F.lit("gap").alias("kind"), line.alias("line"))).otherwise(let(mark, as_mark))

    return let(strip(raw), lambda s: let(F.when(s.rlike(DOTS), "").otherwise(strip(F.regexp_replace(s, r"^\.+", ""))), kind))


def _state(out, tail="", hebrew=False, bare=False, mark="") -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(out.alias("out"), *[as_column(v).alias(n) for n, v in (("tail", tail), ("hebrew", hebrew), ("bare", bare), ("mark", mark))])


def _with(out: Column, s: Column, fresh: bool = True, drop: Column | None = None) -> Column:
    """Another piece: of a logical line of its own, or of the last one, of whose end `drop` code points go."""
    return F.concat(out, F.array(F.struct(F.lit(fresh).alias("fresh"), s.alias("s"), (F.lit(0) if drop is None else drop).alias("drop"))))


def _next(a: Column, x: Column) -> Column:
    """What is known after one more line. An id that waits for its title is `bare` and not told yet; of a paragraph under way the end is kept."""
    line, is_open = x["line"], (a["tail"] != "") & ~a["bare"]
    told = F.when(a["bare"], _with(a["out"], a["tail"])).otherwise(a["out"])

    def identified(t: Column) -> Column:
        """t: the headings that a mark, the last sentence and the whole of the open paragraph would make of the id."""
        found = F.coalesce(t["mark"], t["last"], t["whole"])
        cut = F.when(t["mark"].isNull() & found.isNotNull(), F.length(t["sentence"]))
        cut = F.when(t["mark"].isNull() & t["last"].isNull(), F.when(found.isNotNull(), F.length(a["tail"]))).otherwise(cut)
        left = F.when(cut.isNotNull(), _with(told, F.lit(""), False, cut)).otherwise(told)
        rest = F.when(t["mark"].isNull(), a["mark"]).otherwise("")
        return F.when(found.isNotNull(), _state(_with(left, found), mark=rest)).otherwise(_state(told, _undotted(line), bare=True, mark=rest))

    def of_id() -> Column:
        id_, takes = _undotted(line), is_open & a["hebrew"]
        sentence = F.when(takes, F.element_at(F.split(a["tail"], SENTENCE_END), -1)).otherwise("")
        options = F.struct(sentence.alias("sentence"), _named(id_, a["mark"]).alias("mark"), let(sentence, lambda t: _named(id_, t)).alias("last"), F.when(takes & (F.length(a["tail"]) < TAIL), _named(id_, a["tail"])).alias("whole"))
        return let(options, identified)

    def of_text() -> Column:
        begins = _state(_with(a["out"], line), F.right(line, F.lit(TAIL)), line.rlike(f"[{HEBREW}]"), mark=a["mark"])
        small = line.rlike(r"^\p{Ll}")
        goes_on = lambda piece: _state(_with(a["out"], piece, False), F.right(F.concat(a["tail"], piece), F.lit(TAIL)), a["hebrew"] | line.rlike(f"[{HEBREW}]"), mark=a["mark"])
        wrapped = F.when(small & a["tail"].rlike(r"(?:^|\s)\p{L}{1,4}$"), goes_on(line)).when(small | (F.length(line) < WRAPPED_CHARS), goes_on(F.concat(F.lit(" "), line)))
        return F.when(is_open, F.coalesce(wrapped, begins)).otherwise(begins)

    def after_id(whole: Column) -> Column:
        placeholder = F.concat(a["tail"], F.lit(" Clause "), a["tail"])
        body = _state(_with(_with(a["out"], placeholder), line), F.right(line, F.lit(TAIL)), line.rlike(f"[{HEBREW}]"), mark=a["mark"])
        return F.when(whole.isNotNull(), _state(_with(a["out"], whole), mark=a["mark"])).otherwise(body)

    kind = x["kind"]
    return (
        F.when(kind == "mark", _state(a["out"], a["tail"], a["hebrew"], a["bare"], line))
        .when(kind == "gap", F.when(a["bare"], a).otherwise(_state(a["out"], mark=a["mark"])))
        .when(kind == "head", _state(_with(told, line)))
        .when(kind == "id", of_id())
        .when(a["bare"], let(_named(a["tail"], line), after_id))
        .when(kind == "junk", _state(a["out"], mark=a["mark"]))
        .otherwise(of_text())
    )


def _cut_at(items: Column, opens) -> Column:
    """The runs of an array that begin at items which `opens`; the first run holds what comes before them, and may be empty."""
    at = F.filter(F.transform(items, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull())
    cuts = F.concat(F.array(F.lit(0)), at, F.array(F.size(items)))
    return let(cuts, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.slice(items, F.get(c, i) + 1, F.get(c, i + 1) - F.get(c, i))))


def _logical(lines: Column) -> Column:
    """The logical lines of a run of lines of which the first alone may be a heading."""
    none = F.array().cast("array<struct<fresh:boolean,s:string,drop:int>>")
    pieces = F.aggregate(lines, _state(none), _next, lambda a: F.when(a["bare"], _with(a["out"], a["tail"])).otherwise(a["out"]))

    def joined(unit: Column) -> Column:
        whole = F.array_join(F.transform(unit, lambda p: p["s"]), "")
        cut = F.element_at(unit, -1)["drop"]
        left = F.regexp_replace(strip(F.substring(whole, F.lit(1), F.length(whole) - cut)), SENTENCE_END, " ")
        return F.when(cut > 0, left).otherwise(whole)

    return let(pieces, lambda p: F.transform(F.filter(_cut_at(p, lambda x: x["fresh"]), lambda u: F.size(u) > 0), joined))


def reflowed(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, line_no, line: logical lines of extracted text.

    An id on a line of its own takes its title from a marked heading before it, from the Hebrew paragraph before it (where
    titles come first; its last sentence or all of it), or from the next line; where that is none it is told with a placeholder, and what follows
    is its body. Wrapped lines are joined by what was joined so far; page chrome ends a paragraph and is dropped.

    One pass over a text's lines that carries the open paragraph's end, a waiting id and the last mark, restarted at every
    heading, since nothing is carried past one. No shuffle; a text's lines are handled by the row that holds it.
    """
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), _line)
    runs = docs.select(key, lines.alias("_lines")).select(key, F.flatten(F.transform(_cut_at(F.col("_lines"), lambda x: x["kind"] == "head"), _logical)).alias("_said"))
    return runs.select(key, F.posexplode(F.filter("_said", lambda s: s != "")).alias("line_no", "line"))


def promoted(sections: DataFrame, scope: list[str]) -> DataFrame:
    """Headings and bare ids inside a section's body become sections of their own if they lie below it.

    A bare id's title is the last short line before it that ends no sentence. Of a clause that occurs more than once, bodies are joined.
    """
    key = [*scope, "_of"]
    rows = sections.withColumn("_of", F.struct("sort_order", "clause_id"))
    rows = rows.select(*key, "clause_id", "title", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.split(F.coalesce("body", F.lit("")), "\n", -1), strip))).alias("n", "line"))
    rows = rows.filter("line <> '' or n = 0").filter(~F.col("line").rlike(JUNK_LINE) | (F.col("n") == 0))
    undotted = F.regexp_replace("line", r"^\.+", "")
    found = F.when(undotted.rlike(BARE_ID), F.struct(normal_id(undotted).alias("id"), F.lit(None).cast("string").alias("title"))).otherwise(heading(F.col("line")))
    below = lambda f: F.startswith(f["id"], F.concat("clause_id", F.lit("."))) | (depth(f["id"]) > depth(F.col("clause_id")))
    rows = rows.withColumn("found", found).withColumn("found", F.when(F.col("found").isNotNull() & below(F.col("found")), F.col("found")))
    rows = rows.withColumn("found", F.when(F.col("n") == 0, F.struct(F.col("clause_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"))).otherwise(F.col("found")))
    own = Window.partitionBy(*key).orderBy("n")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("short", F.col("found").isNull() & (F.length("line") <= 80) & ~F.col("line").rlike(r"[.!?…:]$"))
    pending = F.when(F.col("found").isNotNull(), F.struct(F.lit(None).cast("string").alias("line"))).when(F.col("short"), F.struct("line"))  # none right after a heading
    rows = rows.withColumn("pending", F.last(pending, ignorenulls=True).over(so_far)["line"])
    told = F.coalesce("found.title", F.lag("pending").over(own), "found.id")
    takes_last = F.col("found").isNotNull() & F.col("found.title").isNull() & F.lag("short").over(own)
    rows = rows.withColumn("title", F.when(F.col("found").isNotNull(), told)).withColumn("takes", F.coalesce(takes_last, F.lit(False)))
    rows = rows.withColumn("taken", F.coalesce(F.lead("takes").over(own), F.lit(False)))
    rows = rows.withColumn("id", F.last("found.id", ignorenulls=True).over(so_far)).filter("not taken")
    place = F.struct("_of", "n")
    whole = rows.groupBy(*scope, F.col("id").alias("clause_id")).agg(
        F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", place)).alias("title"),
        F.array_sort(F.collect_list(F.when(F.col("found").isNull(), F.struct("_of", "n", "line")))).alias("lines"),
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    return whole.select(*scope, "clause_id", F.coalesce("title", F.lit("")).alias("title"), repaired_words(without_junk(body)).alias("body"), sort_key(F.col("clause_id")).alias("sort_order"))


def by_style(blocks: DataFrame, key: str) -> DataFrame:
    """key, clause_id, title, body, sort_order of blocks (key, pos, level, text), numbered by running counters of heading levels 1 to 3.

    A second level before any first, or a third before any second, opens nothing.
    """
    own = Window.partitionBy(key).orderBy("pos")
    count = lambda level, w: F.sum((F.col("level") == level).cast("int")).over(w)
    rows = blocks.withColumn("a", count(1, own))
    rows = rows.withColumn("b", F.sum(((F.col("level") == 2) & (F.col("a") > 0)).cast("int")).over(Window.partitionBy(key, "a").orderBy("pos")))
    rows = rows.withColumn("c", F.sum(((F.col("level") == 3) & (F.col("b") > 0)).cast("int")).over(Window.partitionBy(key, "a", "b").orderBy("pos")))
    number = F.concat_ws(".", F.col("a").cast("string"), F.when(F.col("level") > 1, F.col("b").cast("string")), F.when(F.col("level") > 2, F.col("c").cast("string")))
    opens = (F.col("level") == 1) | ((F.col("level") == 2) & (F.col("a") > 0)) | ((F.col("level") == 3) & (F.col("b") > 0))
    head = F.when(opens, F.struct(number.alias("id"), F.col("text").alias("title")))
    return _opened(rows.withColumn("head", head), key, F.col("level").isNull())


def faithful(blocks: DataFrame, key: str) -> DataFrame:
    """key, clause_id, title, body, sort_order of blocks (key, pos, level, text) by the headings their texts are, in document order."""
    from ..functions.text import lead_of, title_of

    told = heading(F.regexp_replace("text", r"\s+", " "))
    rows = blocks.withColumn("told", told).withColumn("head", F.when(F.col("told").isNotNull(), F.struct(F.col("told.id").alias("id"), title_of(F.col("told.title")).alias("title"))))
    rows = rows.withColumn("text", F.when(F.col("told").isNotNull(), lead_of(F.col("told.title"))).otherwise(F.col("text")))
    return _opened(rows, key, F.lit(True))


def _opened(rows: DataFrame, key: str, body: Column) -> DataFrame:
    own = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("id", F.last("head.id", ignorenulls=True).over(own)).filter("id is not null")
    said = F.when((F.col("text") != "") & body, F.struct("pos", "text"))
    whole = rows.groupBy(key, F.col("id").alias("clause_id")).agg(F.max_by("head.title", F.when(F.col("head").isNotNull(), F.col("pos"))).alias("title"), F.array_sort(F.collect_list(said)).alias("said"))
    text = F.array_join(F.transform("said", lambda x: x["text"]), "\n\n")
    return whole.select(key, "clause_id", "title", repaired_words(without_junk(text)).alias("body"), sort_key(F.col("clause_id")).alias("sort_order"))


def foreign_title(title: Column, markers: list[str], own: list[str]) -> Column:
    """A heading that marks another standard: equal to a marker, beginning with it, or holding it as a word; not if it is one of this standard's."""
    t = strip(F.coalesce(title, F.lit("")))
    hit = F.lit(False)
    for m in markers:
        hit = hit | (t == m) | F.startswith(t, F.lit(m + " ")) | F.contains(t, F.lit(" " + m))
    return (t != "") & hit & ~t.isin(*own)


def with_repaired_titles(sections: DataFrame, known: DataFrame, language: str, markers: list[str] | None = None, own: list[str] | None = None) -> DataFrame:
    """Titles by the standard's own dictionary `known` (clause_id, canonical): broken or foreign ones are replaced, by a placeholder where it has none."""
    rows = sections.join(known.select("clause_id", "canonical"), "clause_id", "left")
    raw = strip(F.coalesce("title", F.lit("")))
    cut = strip(F.regexp_replace(F.substring(raw, F.length("clause_id") + 1, F.length(raw)), r"^\s*[.\-–—:]?\s*", ""))
    title = F.when(F.startswith(raw, F.col("clause_id")), F.coalesce(F.nullif(cut, F.lit("")), raw)).otherwise(raw)
    rows = rows.withColumn("_t", title)
    t, c = F.col("_t"), F.col("canonical")
    swapped = t.isin("הקדמה", "מנהיגות ומחויבות") & F.col("clause_id").isin("0.1", "5.1.1")
    off = bad_title(t) | ~compatible_title(t, c) | ((t != c) & ((F.length(t) > 60) | F.contains(t, F.lit("ציור")) | swapped))
    fallback = F.concat(F.lit("סעיף " if language.startswith("he") else "Clause "), F.col("clause_id"))
    new = (
        F.when(foreign_title(t, markers or [], own or []), F.coalesce(c, fallback))
        .when(c.isNotNull() & off, c)
        .when(bad_title(t), F.coalesce(c, fallback))
        .otherwise(t)
    )
    return rows.withColumn("title", new).select(*sections.columns)


ANCHORS = ("1", "4", "6", "7", "8", "9", "10")


def structure_gate(sections: DataFrame, scope: list[str], known: DataFrame, hebrew: bool = False) -> DataFrame:
    """scope, the measures and ok: enough sections, third levels and text, few bad titles, an introduction, and sound anchor titles."""
    rows = sections.filter(is_core(F.col("clause_id"))).join(known.filter(F.col("clause_id").isin(*ANCHORS)).select("clause_id", "canonical"), "clause_id", "left")
    broken = (F.col("clause_id").isin("1", "4.1") & bad_title(F.col("title"))) | (F.col("canonical").isNotNull() & ~compatible_title(F.col("title"), F.col("canonical")))
    found = rows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_core"),
        F.count_if(depth(F.col("clause_id")) >= 3).alias("n_level3"),
        F.coalesce(F.sum(F.length(strip(F.coalesce("body", F.lit(""))))), F.lit(0)).alias("n_chars"),
        F.count_if(bad_title(F.col("title"))).alias("n_bad"),
        F.count_if((F.col("clause_id") == "0") | F.startswith(F.col("clause_id"), F.lit("0."))).alias("n_intro"),
        F.count_if(broken).alias("n_broken"),
    )
    ok = (F.col("n_core") >= 40) & (F.col("n_level3") >= 12) & (F.col("n_chars") >= (8000 if hebrew else 4000))
    ok = ok & (F.col("n_bad") <= F.col("n_core") * (0.15 if hebrew else 0.25)) & (F.col("n_intro") > 0) & (F.col("n_broken") == 0)
    return found.withColumn("ok", ok)


def merged_by_quality(sets: DataFrame, scope: list[str], order: str = "set") -> DataFrame:
    """Of a clause in several sets, the better by (good title, length of body, length of title); a winner takes over what it lacks.

    A winner of a bad title also takes a body that is 1.3 times as long as its own from a predecessor of a good one.
    """
    item = F.struct(order, strip(F.coalesce("title", F.lit(""))).alias("title"), strip(F.coalesce("body", F.lit(""))).alias("body"), bad_title(F.col("title")).alias("bad"))
    rows = sets.groupBy(*scope, normal_id(F.col("clause_id")).alias("clause_id")).agg(F.array_sort(F.collect_list(item)).alias("x")).filter("clause_id <> ''")
    quality = lambda v: F.struct((~v["bad"]).cast("int").alias("a"), F.length(v["body"]).alias("b"), F.length(v["title"]).alias("c"))

    def step(a, v):
        longer = v["bad"] & ~a["bad"] & (v["body"] != "") & (a["body"] != "") & (F.length(a["body"]) > F.length(v["body"]) * 1.3)
        body = F.when((v["body"] == "") | longer, a["body"]).otherwise(v["body"])
        title = F.when(v["title"] == "", a["title"]).otherwise(v["title"])
        won = F.struct(v[order].alias(order), title.alias("title"), body.alias("body"), F.when(v["title"] == "", a["bad"]).otherwise(v["bad"]).alias("bad"))
        return F.when(quality(v) > quality(a), won).otherwise(a)

    best = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.lit(0), F.size("x") - 1)), F.get("x", F.lit(0)), step)
    return rows.withColumn("best", best).select(*scope, "clause_id", "best.title", "best.body", sort_key(F.col("clause_id")).alias("sort_order"))


def merged_segments(items: DataFrame, scope: list[str], order: list[str], core_only: bool = True) -> DataFrame:
    """Clauses told in several segments: the first title there is, and bodies joined unless one is within what stands already."""
    clause = normal_id(F.coalesce("clause_id", F.lit("")))
    rows = items.withColumn("clause_id", clause).filter(F.col("clause_id").rlike(r"^\d{1,2}(?:\.\d{1,2}){0,4}$"))
    rows = rows.filter(is_core(F.col("clause_id"))) if core_only else rows
    told = F.struct(*order, strip(F.coalesce("title", F.lit(""))).alias("title"), strip(F.coalesce("body", F.lit(""))).alias("body"))
    rows = rows.groupBy(*scope, "clause_id").agg(F.array_sort(F.collect_list(told)).alias("x"))
    step = lambda a, v: F.when(F.contains(a, v["body"]), a).when(a == "", v["body"]).otherwise(F.concat(a, F.lit("\n\n"), v["body"]))
    title = F.coalesce(F.get(F.filter(F.transform("x", lambda v: v["title"]), lambda t: t != ""), F.lit(0)), F.lit(""))
    return rows.select(*scope, "clause_id", title.alias("title"), F.aggregate("x", F.lit(""), step).alias("body"), sort_key(F.col("clause_id")).alias("sort_order"))


def repaired_corpus(sections: DataFrame, scope: list[str], known: DataFrame, language: str) -> DataFrame:
    """Sections without pollution (marked headings, crosswalks, over-deep introductions, misplaced 4.x, empty ones of bad titles), rolled up and retitled."""
    from .sections import rolled_up, with_ancestors

    rows = with_repaired_titles(with_ancestors(promoted(sections, scope), scope), known, language)
    id_, title = F.col("clause_id"), F.col("title")
    intro = F.regexp_extract("clause_id", r"^0\.(\d+)$", 1).try_cast("int") >= 5
    crosswalk = F.startswith(title, F.lit("##")) | F.contains(title, F.lit("ISO 10002")) | F.contains(title, F.lit("Correspondence")) | F.contains(title, F.lit("התאמה בין"))
    misplaced = id_.rlike(r"^4\.(5|4\.[345])") if language == "en" else F.lit(False)
    empty = bad_title(title) & blank(F.col("body"))
    rows = rows.filter(~(F.coalesce(intro, F.lit(False)) | crosswalk | misplaced | empty))
    return with_repaired_titles(rolled_up(rows, scope), known, language)
