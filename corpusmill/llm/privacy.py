"""Personal data and the terms that give it away.

Base spans (email, ip, card, phone) are found by pattern and checked by value; so
are secrets (keys and tokens: long runs of letters and digits). On top, an
information-theoretic measure finds terms that disclose a protected entity. With
document frequencies over all documents, a term t carries
pmi(t; e) = log2(N df(t, e) / (df(t) df(e))) bits of e's information content
ic(e) = log2(N / df(e)). In documents that hold e, a term whose share pmi/ic
reaches `remove` is removed, one that reaches `generalise` is replaced by what
kind of word it is and what it gives away.

Protected entities are, first, each kind of value: most values are unique, so
what can be learned of them is which words stand beside such a value. There,
evidence is the number of different values a term was seen with, so that copies
of a text count once; df(t, e) counts the documents that hold e and say t outside
of values, anywhere in the text. Second, each value that recurs, where evidence is
the number of different texts; values that occur in the same documents are one
entity. There df(t, e) counts the documents that say t within `NEAR` code points
of such a value, so a page of many values has pairs in proportion to its values
and not to these times its words. Pairs of less than `support` evidence are no
evidence; df(t) counts the documents that say t. A term that discloses an entity
is treated wherever a document that holds the entity says it.

Words are runs of two or more letters and digits, A-Z in lower case.

The patterns are written so that Java's matcher neither recurses nor rescans:
single separators inside digit runs and single dots inside domains are first
marked by a private character of the same length, which makes card and domain
plain character runs; a run that can't begin a match is skipped whole.

Defined cases: null text is empty; repeated rows count repeatedly and get equal
results; spans of a kind don't overlap, a disclosing term never overlaps a base
span or a secret; no rows give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, small, table, text_key, written

KINDS = ("email", "ip", "card", "phone")
GUARDED = (*KINDS, "secret")
SUPPORT = 5
GENERALISE, REMOVE = 0.8, 0.95
#: Code points on either side of a recurring value, less the words that these cut.
NEAR = 1000
MARK = "\ue000"
LOCAL = r"A-Za-z0-9._%+\-" + MARK

#: By kind: the single characters that are marked, and the pattern over marked text.
PATTERNS = {
    "email": (r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9\-{MARK}]++"),
    "ip": (None, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?<=[0-9])[\x20-](?=[0-9])", rf"[0-9][0-9{MARK}]++"),
    "phone": (None, r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (None, r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{32,}+"),
}
#: What a text must hold to be searched for a kind at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
EDGE = r"[\p{L}\p{N}]"
WORD = EDGE + "{2,}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + F.when((F.length(digits) - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "secret":
        return (F.length(digits) >= 6) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _entity(kind: str, s: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(s["value"]))


def _placed(found: Column, between: Column) -> Column:
    """start, end, value of each match, from the matches and the text between them."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    walk = F.aggregate(
        F.transform(found, lambda m, i: F.struct(F.length(m).alias("m"), F.length(F.get(between, i)).alias("p"))),
        state,
        lambda s, x: F.struct(
            (s["at"] + x["p"] + x["m"]).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + x["p"]).alias("start"), (s["at"] + x["p"] + x["m"]).alias("end")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.transform(F.arrays_zip(walk.alias("w"), found.alias("v")), lambda z: F.struct(z["w"]["start"].alias("start"), z["w"]["end"].alias("end"), z["v"].alias("value")))


def matches(df: DataFrame) -> DataFrame:
    """Adds a column of spans for each kind: start, end (code points), value."""
    for kind in GUARDED:
        mark, pattern = PATTERNS[kind]
        text = F.when(F.contains("text", F.lit(NEEDS[kind])), F.col("text")) if NEEDS[kind] else F.col("text")
        if mark:
            text = F.regexp_replace(F.translate(text, MARK, "\ufffd"), mark, MARK)
        df = df.withColumn("_marked", text)
        df = df.withColumn("_found", F.coalesce(F.regexp_extract_all("_marked", F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
        between = F.when(F.size("_found") > 0, F.split("_marked", pattern, -1))
        df = df.withColumn("_between", between)
        df = df.withColumn(kind, F.filter(_placed(F.col("_found"), F.col("_between")), _checked(kind))).drop("_marked", "_found", "_between")
    return df


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _text, a column of spans for each kind and the text of rows that have any (null: none)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.coalesce("text", F.lit("")).alias("text"))
    any_of = F.size(F.concat(*GUARDED)) > 0
    return matches(rows).withColumn("text", F.when(any_of, F.col("text")))


def edited(text: Column, marks: Column, pad: str) -> Column:
    """The text with each mark (start, end, by) replaced; where marks overlap, the later one's rest is filled with `pad`."""

    def step(a, m):
        fresh = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, m["start"] - a["at"]), m["by"]))
        rest = F.concat(a["out"], F.array(F.repeat(F.lit(pad), F.greatest(F.lit(0), m["end"] - a["at"]))))
        return F.struct(F.greatest(a["at"], m["end"]).alias("at"), F.when(m["start"] >= a["at"], fresh).otherwise(rest).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.array_sort(marks), start, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))


def _masked() -> Column:
    """The text in lower case with blanks for all values, of equal length."""
    blank = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - s["start"]).alias("by"))
    return F.translate(edited(F.col("text"), F.concat(*[F.transform(k, blank) for k in GUARDED]), " "), UPPER, LOWER)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def _beside(masked: Column, s: Column, near: int) -> Column:
    """The distinct words that lie whole within `near` code points of a span."""
    first = F.greatest(F.lit(0), s["start"] - near)
    text = F.substring(masked, first + 1, s["end"] + near - first)
    text = F.when(first > 0, F.regexp_replace(text, rf"^{EDGE}++", "")).otherwise(text)
    return _terms(F.when(s["end"] + near < F.length(masked), F.regexp_replace(text, rf"{EDGE}++$", "")).otherwise(text))


class Said:
    """What texts with values say.

    rows: _id, _text, masked, words, and kinds (entity, kind, evidence) held; own: _id, _text and the recurring entities held;
    beside: _id, _text, term, entity, kind, evidence for the words beside recurring values.
    """

    def __init__(self, base: DataFrame, support: int = SUPPORT, near: int = NEAR) -> None:
        rows = base.filter("text is not null").withColumn("masked", _masked())
        told = lambda k: lambda s: F.struct(_entity(k, s).alias("value"), s["start"].alias("start"), s["end"].alias("end"))
        spans = F.concat(*[F.transform(k, told(k)) for k in GUARDED])
        held = rows.select("_id", "_text", "masked", spans.alias("spans"), *GUARDED)
        held = written(held.withColumn("beside", F.transform("spans", lambda s: F.struct(s["value"].alias("value"), _beside(F.col("masked"), s, near).alias("terms")))), "held")
        each = F.array_distinct(F.transform("spans", lambda s: s["value"]))
        values = written(held.select("_id", "_text", F.explode(each).alias("value")), "values")
        # by text first: a value that a third of all rows hold is summed in parts
        known = values.groupBy("value", "_text").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_id", "_text")).alias("in"))
        known = known.groupBy("value").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.bit_xor("in").alias("in")).filter(F.col("texts") >= support)
        named = known.select("value", F.concat_ws(":", F.lit("value"), F.col("n").cast("string"), F.hex("in")).alias("entity"), F.split_part("value", F.lit(":"), F.lit(1)).alias("kind"))
        named = written(named, "recurring")
        self.own = written(lookup(values, named, ["value"]).select("_id", "_text", "entity", "kind").distinct(), "own")
        beside = held.select("_id", "_text", F.explode("beside").alias("b")).select("_id", "_text", "b.value", F.col("b.terms").alias("terms"))
        beside = lookup(beside, named, ["value"]).select("_id", "_text", F.explode("terms").alias("term"), "entity", "kind", F.col("_text").alias("evidence"))
        self.beside = written(beside.distinct(), "beside")
        kinds = F.array(*[F.when(F.size(k) > 0, F.struct(F.lit(k).alias("entity"), F.lit(k).alias("kind"), F.array_min(F.transform(k, lambda s: F.xxhash64(F.lower(s["value"])))).alias("evidence"))) for k in GUARDED])
        self.rows = written(held.select("_id", "_text", "masked", _terms(F.col("masked")).alias("words"), F.filter(kinds, lambda x: x.isNotNull()).alias("kinds")), "said")

    def pairs(self) -> DataFrame:
        """_id, _text, term, entity, kind, evidence: of each kind held all words, of each recurring value those beside it."""
        rows = self.rows.select("_id", "_text", F.explode("words").alias("term"), "kinds")
        return rows.select("_id", "_text", "term", F.explode("kinds").alias("e")).select("_id", "_text", "term", "e.entity", "e.kind", "e.evidence").unionByName(self.beside)

    def entities(self) -> DataFrame:
        """_id, _text, entity, kind of all entities held."""
        kinds = self.rows.select("_id", "_text", F.explode("kinds").alias("e")).select("_id", "_text", "e.entity", "e.kind")
        return kinds.unionByName(self.own)


def disclosing(docs: DataFrame, told: Said, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """entity, kind, term, share: the terms that give entities away."""
    total = docs.count()
    entities = told.entities().groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    pairs = told.pairs().groupBy("entity", "kind", "term", "evidence").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.min("kind").alias("kind"), F.sum("n").alias("df_te"), F.count_distinct("evidence").alias("seen")).filter(F.col("seen") >= support)
    pairs = written(pairs.join(small(written(entities, "entities")), "entity"), "pairs")
    # all words are counted before they meet the terms: the join has a row a term
    words = docs.select(F.explode(_terms(F.translate("text", UPPER, LOWER))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    rated = pairs.join(words, "term")
    pmi = F.log2(F.lit(float(total)) * F.col("df_te") / (F.col("df_t") * F.col("df_e")))
    ic = F.log2(F.lit(float(total)) / F.col("df_e"))
    return rated.select("entity", "kind", "term", F.when(ic > 0, pmi / ic).alias("share")).filter(F.col("share") >= generalise)


TERM = "array<struct<start:int,end:int,term:string,share:double,kind:string>>"


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, _id, _text, a column of spans for each kind, terms (start, end, term, share, kind), and text of rows that have values."""
    base = written(base_spans(docs), "base")
    told = Said(base, support)
    rated = written(disclosing(docs, told, support, generalise), "rated")
    rated = rated.groupBy("entity").agg(F.collect_list(F.struct("term", "share", "kind")).alias("terms"))  # an entity's own
    hits = told.entities().select("_id", "_text", "entity").join(small(written(rated, "rated")), "entity").select("_id", "_text", F.explode("terms").alias("t"))
    hits = hits.groupBy("_id", "_text", "t.term").agg(F.max(F.struct("t.share", "t.kind")).alias("m"))
    hits = hits.join(told.rows.select("_id", "_text", F.explode("words").alias("term")), ["_id", "_text", "term"], "left_semi")
    hits = hits.groupBy("_id", "_text").agg(F.map_from_entries(F.collect_list(F.struct("term", "m"))).alias("known"))  # a text's own words
    places = told.rows.select("_id", "_text", "masked").dropDuplicates(["_id", "_text"]).join(small(written(hits, "hits")), ["_id", "_text"])
    places = places.withColumn("pattern", F.concat(F.lit(f"(?<!{EDGE})(?:"), F.array_join(F.array_sort(F.map_keys("known")), "|"), F.lit(f")(?!{EDGE})")))
    spans = _placed(F.regexp_extract_all("masked", F.col("pattern"), F.lit(0)), F.split("masked", F.col("pattern"), -1))
    known = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("term"), F.col("known")[s["value"]]["share"].alias("share"), F.col("known")[s["value"]]["kind"].alias("kind")))
    places = written(places.select("_id", "_text", known.alias("terms")), "places")
    return base.join(small(places), ["_id", "_text"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERM)))


def cleaned(remove: float = REMOVE) -> Column:
    """The text of a row of `find`: values become their kind; terms go or become a word of their kind and what it gives away."""
    by = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{k}>").alias("by"))
    shape = lambda t: F.when(t["term"].rlike(r"\p{N}"), "code").otherwise("word")
    general = lambda t: F.concat(F.lit("<"), shape(t), F.lit(" of "), t["kind"], F.lit(">"))
    marks = [F.transform(k, by(k)) for k in GUARDED]
    marks.append(F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= remove, "").otherwise(general(t)).alias("by"))))
    return edited(F.col("text"), F.concat(*marks), "")


def sanitise(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """doc_id and text with values replaced by their kind, disclosing terms removed or generalised."""
    new = find(docs).filter("text is not null").select("_id", "_text", cleaned(remove).alias("new")).dropDuplicates(["_id", "_text"])
    rows = docs.select("doc_id", *text_key(), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(small(written(new, "new")), ["_id", "_text"], "left").select("doc_id", F.coalesce("new", "text").alias("text"))


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and of the method: all spans, removed and generalised terms, and the cleaned text's digest (null: unchanged)."""
    rows = find(table(spark, sf_dir, "documents"))
    told = lambda k, c: F.transform(c, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[told(k, k) for k in KINDS])
    removed, general = F.filter("terms", lambda t: t["share"] >= REMOVE), F.filter("terms", lambda t: t["share"] < REMOVE)
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, told("secret", "secret"), told("removed", removed), told("generalised", general)), ",").alias("spans"),
        *[F.size(c).cast("long").alias(n) for c, n in (("secret", "n_secret"), ("terms", "n_terms"), (removed, "n_removed"), (general, "n_generalised"))],
        F.when(F.col("text").isNotNull(), F.sha2(cleaned().cast("binary"), 256)).alias("cleaned_sha256"),
    )
