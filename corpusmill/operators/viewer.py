"""What a reader of the corpus is shown, and checks of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.data import has_key
from ..functions.ids import ID_TOKEN, depth, parent_id, sort_key
from ..functions.text import HEBREW, bad_title, blank, hebrew_body, hebrew_ratio, hebrew_spacing, paragraphs, strip

# Terms of a resume in three languages.
CV_MARKS = ("curriculum vitae", "resume", "קורות חיים", "سيرة ذاتية")
CV_TERMS = (
    "experience", "education", "skills", "employment", "summary", "objective",
    "ניסיון", "השכלה", "כישורים", "תעסוקה",
    "خبرة", "تعليم", "مهارات", "السيرة",
)
MODES = {"iso_only": "iso_only", "cv_analysis": "cv_analysis", "cv": "cv_analysis"} | {m: "speech_any_subject" for m in ("speech_any_subject", "any_subject", "speech_any")}


def viewer_record(rows: DataFrame, language: str, fallback: Column) -> DataFrame:
    """clause_id, title, language, text, direction, fallback, source, edition, parent and depth of sections (clause_id, title, body, source, edition)."""
    body = F.coalesce("body", F.lit(""))
    return rows.select(
        "clause_id",
        "title",
        F.lit(language).alias("language"),
        (hebrew_body(body) if language == "he" else body).alias("text"),
        F.lit("rtl" if language == "he" else "ltr").alias("direction"),
        fallback.alias("fallback"),
        F.coalesce("source", F.lit("seed")).alias("source"),
        F.coalesce("edition", F.lit("")).alias("edition"),
        F.coalesce(parent_id(F.col("clause_id")), F.lit("")).alias("parent_clause_id"),
        depth(F.col("clause_id")).alias("depth"),
    )


def first_or(values: Column, default: str) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(default))


def distinct_or(rows: DataFrame, column: str, default: str) -> DataFrame:
    """The distinct values in order, or the default alone where there are none."""
    found = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    none = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(default).alias(column))
    return found.unionByName(none).orderBy(column)


def by_stage(rows: DataFrame, stages: list[str], *ties: str) -> DataFrame:
    """In order of stage, latest version first, then by `ties`; unknown stages last."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")), F.lit(0)), F.lit(len(stages) + 1))
    return rows.orderBy(order, F.desc("version"), *ties)


def published(versions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the highest version that is published."""
    return versions.filter("is_published").groupBy(*keys).agg(F.max("version").alias("version"))


def upload_status(rows: DataFrame, status: str = "status_json") -> DataFrame:
    """id, state, progress and error of uploads whose status is a JSON object; missing entries get defaults."""
    read = lambda key, default: F.coalesce(F.when(has_key(F.col(status), key), F.get_json_object(status, f"$.{key}")), F.lit(default))
    return rows.select("id", read("state", "pending").alias("state"), F.coalesce(read("progress", "0").try_cast("int"), F.lit(0)).alias("progress"), read("error", "").alias("error"))


def cv_like(text: Column, least: int = 3, head: int = 8000) -> Column:
    """A resume by what its beginning calls itself or by the section terms in it."""
    lower = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    holds = lambda terms: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(lower, t))
    return (F.size(holds(CV_MARKS)) > 0) | (F.size(holds(CV_TERMS)) >= least)


def guardrail_mode(mode: Column, text: Column, default: str = "iso_only") -> Column:
    """The asked mode under its full name, the default for unknown ones; a resume turns the default topic into that of resumes."""
    asked = F.lower(F.trim(F.coalesce(F.nullif(mode, F.lit("")), F.lit(default))))
    named = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    known = F.coalesce(F.try_element_at(named, asked), F.lit("iso_only"))
    return F.when((known == "iso_only") & cv_like(text), "cv_analysis").otherwise(known)


def guarded(text: Column, keywords: list[str], mode: Column) -> Column:
    """Whether a text may pass: any in the free mode, else resumes in theirs or those with a keyword."""
    hit = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k))
    mode = guardrail_mode(mode, text)
    return F.coalesce((mode == "speech_any_subject") | ((mode == "cv_analysis") & cv_like(text)) | hit, F.lit(False))


def page_lines(words: DataFrame, key: list[str]) -> DataFrame:
    """key, text of pages from word boxes (key, block, line, x, y, word): lines by height, words by place.

    Mostly Hebrew lines run from right to left after the clause ids that lead them.
    """
    said = words.withColumn("word", strip(F.col("word"))).filter("word <> ''")
    lines = said.groupBy(*key, "block", "line").agg(F.min("y").alias("y"), F.array_sort(F.collect_list(F.struct("x", "word"))).alias("w"))
    lines = lines.withColumn("w", F.transform("w", lambda w: w["word"]))
    lead = F.aggregate("w", F.lit(0), lambda n, w: F.when((n >= 0) & w.rlike(ID_TOKEN), n + 1).when(n >= 0, -n - 1).otherwise(n), lambda n: F.when(n >= 0, n).otherwise(-n - 1))
    plain = F.array_join("w", " ")
    turned = F.concat(F.slice("w", F.lit(1), lead), F.reverse(F.slice("w", lead + 1, F.size("w"))))
    line = F.when(hebrew_ratio(plain) < 0.4, plain).otherwise(hebrew_spacing(F.array_join(turned, " ")))
    blocks = lines.select(*key, "block", F.struct("y", "line", line.alias("said")).alias("l")).groupBy(*key, "block").agg(F.array_sort(F.collect_list("l")).alias("l"))
    blocks = blocks.select(*key, "block", F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("said"))
    return blocks.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "said"))), lambda x: x["said"]), "\n\n").alias("text"))


def tokenised(text: Column) -> Column:
    """A body of many paragraphs that are nearly all one or two words."""
    p = paragraphs(F.coalesce(text, F.lit("")))
    tiny = F.size(F.filter(p, lambda x: F.size(F.split(x, r"\s+")) <= 2))
    return (F.length(text) >= 80) & (F.size(p) >= 8) & (tiny > F.size(p) * 0.6)


def viewer_audit(records: DataFrame) -> DataFrame:
    """language, check, n, ok: counts, introductions, known titles, foreign script, fallbacks, tokenised bodies and titles that are body text of viewer records.

    Checks of Hebrew titles and bodies are made of Hebrew records alone, the one of foreign script of the others.
    """
    he = F.col("language") == "he"
    script = F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    intro = F.col("clause_id") == "0"
    n = records.groupBy("language").agg(
        F.count(F.lit(1)).alias("sections"),
        F.count_if(F.size(F.split("clause_id", r"\.")) == 3).alias("level3"),
        F.count_if(intro).alias("introduction"),
        F.count_if(intro & F.col("title").isin("Introduction", "מבוא")).alias("introduction_title"),
        F.count_if(intro & (F.length("text") > 100)).alias("introduction_body"),
        F.count_if(intro & F.contains("text", F.lit(" ")) & (F.size(F.split("text", "\n\n")) <= 30)).alias("introduction_words"),
        F.count_if(F.col("clause_id") == "0.1").alias("general"),
        F.count_if(F.col("clause_id").isin("0", "0.1")).alias("front"),
        F.min_by("clause_id", F.struct(sort_key(F.col("clause_id")), "clause_id")).alias("first"),
        F.count_if((F.col("clause_id") == "0.1") & (F.col("title") == "כללי")).alias("general_title"),
        F.count_if((F.col("clause_id") == "5.1.1") & (F.col("title") == "כללי")).alias("leadership_title"),
        F.count_if((F.col("clause_id") == "5.1.2") & F.contains("title", F.lit("לקוח"))).alias("customer_title"),
        F.count_if(tokenised(hebrew_body(F.coalesce("text", F.lit(""))))).alias("rejoined"),
        F.count_if(~he & script.rlike(f"[{HEBREW}]")).alias("foreign_script"),
        F.count_if(F.col("fallback")).alias("fallbacks"),
        F.count_if(he & tokenised(F.col("text"))).alias("tokenised"),
        F.count_if(he & ((F.length("title") > 60) | F.col("title").rlike(r"^(?:\( )?הערה"))).alias("body_titles"),
        F.count_if(bad_title(F.col("title")) & blank(F.col("text"))).alias("empty"),
    )
    n = n.withColumn("first", F.col("first").isin("0", "0.1").cast("long"))
    least = {"sections": 80, "level3": 30} | dict.fromkeys(("introduction", "introduction_title", "introduction_body", "introduction_words", "general", "front", "first", "general_title", "leadership_title", "customer_title"), 1)
    hebrew_only, others_only = {"general_title", "leadership_title", "customer_title", "rejoined", "tokenised", "body_titles"}, {"foreign_script"}
    checks = [F.struct(F.lit(c).alias("check"), F.col(c).alias("n"), ((F.col(c) >= least[c]) if c in least else (F.col(c) == 0)).alias("ok")) for c in n.columns if c != "language"]
    made = n.select("language", F.explode(F.array(*checks)).alias("c")).select("language", "c.*")
    return made.filter(F.when(F.col("language") == "he", ~F.col("check").isin(*others_only)).otherwise(~F.col("check").isin(*hebrew_only)))


def mixed_script_titles(sections: DataFrame) -> DataFrame:
    """language, standard, clause_id, title (60 characters), issue: Hebrew letters in English titles, Latin words other than ISO in Hebrew ones."""
    title, language = F.col("title"), F.col("language")
    issue = F.when((language == "en") & title.rlike("[א-ת]"), "hebrew in en").when((language == "he") & title.rlike("[A-Z][a-z]{3,}") & ~F.contains(title, F.lit("ISO")), "latin in he")
    return sections.withColumn("issue", issue).filter("issue is not null").select("language", "standard", "clause_id", F.substring("title", 1, 60).alias("title"), "issue")
