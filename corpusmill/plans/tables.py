"""Queries over tables: joins, aggregates, versions, state, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import data, ids
from ..functions import text as tx
from ..operators import quality, sections, state
from ..sources.sinks import report
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT c_custkey, c_name, count(o_orderkey)::BIGINT AS n_orders, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def mappings_nested(spark, folder):
    """Each parent with the list of its children, empty for none: children are gathered before the join."""
    each = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    rows = table(spark, folder, "customer").select("c_custkey", "c_name").join(each, "c_custkey", "left")
    keys = F.coalesce("keys", F.array().cast("array<bigint>"))
    return rows.select("c_custkey", "c_name", F.size(keys).cast("long").alias("n_orders"), F.array_join(keys.cast("array<string>"), ",").alias("orders"))


@query("SELECT doc_id, d.lang, d.source, quality, toxic, '/' || d.source || '/' || doc_id AS path FROM labels JOIN documents d USING (doc_id)")
def files_join_metadata(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return table(spark, folder, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", "quality", "toxic", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


@query("""SELECT source, min(doc_id) FILTER (WHERE lang = 'en') AS en, min(doc_id) FILTER (WHERE lang = 'fr') AS fr,
  min(doc_id) FILTER (WHERE lang = 'en') IS NOT NULL AND min(doc_id) FILTER (WHERE lang = 'fr') IS NOT NULL AS both FROM documents GROUP BY source""")
def bilingual_pivot(spark, folder):
    rows = table(spark, folder, "documents").groupBy("source").pivot("lang", ["en", "fr"]).agg(F.min("doc_id"))
    return rows.withColumn("both", F.col("en").isNotNull() & F.col("fr").isNotNull())


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IN ('en', 'es') GROUP BY ALL), s AS (SELECT DISTINCT source FROM n WHERE lang = 'es')
SELECT source, lang, n::BIGINT AS n, lang <> 'es' AS fallback FROM n WHERE lang = 'es' OR source NOT IN (SELECT source FROM s)""")
def set_level_fallback(spark, folder):
    """The other language's rows only where a source has none of the asked one."""
    rows = table(spark, folder, "documents").filter(F.col("lang").isin("en", "es")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    first = rows.filter("lang = 'es'")
    return first.unionByName(rows.filter("lang = 'en'").join(first.select("source"), "source", "left_anti")).withColumn("fallback", F.col("lang") != "es")


@query(r"""WITH f AS (SELECT source, max(text) FILTER (WHERE lang = 'de' AND n_chars > 1000) AS a, max(text) FILTER (WHERE lang = 'en') AS b FROM documents GROUP BY source)
SELECT source, md5(coalesce(nullif(trim(a), ''), b, '')) AS body_md5, coalesce(trim(a), '') = '' AS fallback FROM f""")
def row_level_fallback(spark, folder):
    rows = table(spark, folder, "documents").groupBy("source").agg(F.max(F.when((F.col("lang") == "de") & (F.col("n_chars") > 1000), F.col("text"))).alias("a"), F.max(F.when(F.col("lang") == "en", F.col("text"))).alias("b"))
    a = F.trim("a")
    return rows.select("source", F.md5(F.coalesce(F.nullif(a, F.lit("")), "b", F.lit("")).cast("binary")).alias("body_md5"), (F.coalesce(a, F.lit("")) == "").alias("fallback"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def existence_semi(spark, folder):
    big = table(spark, folder, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def insert_ignore_anti(spark, folder):
    taken = table(spark, folder, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return state.insert_ignore(taken, table(spark, folder, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def dictionary_lookup(spark, folder):
    names = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, folder, "nation").join(names, "n_regionkey", "left").select("n_nationkey", "n_name", "r_name")


@query("SELECT lang, source, count(*)::BIGINT AS n, max(n_chars) AS longest FROM documents GROUP BY lang, source")
def clause_counts(spark, folder):
    return table(spark, folder, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source")
def doc_type_counts(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (WHERE b > 100)::BIGINT AS n_full, count(*) FILTER (WHERE b BETWEEN 1 AND 100)::BIGINT AS n_partial,
  count(*) FILTER (WHERE b = 0)::BIGINT AS n_empty, (count(*) FILTER (WHERE b > 100) * 100 // count(*))::BIGINT AS full_pct
FROM (SELECT lang, length(coalesce(text, '')) AS b FROM documents) GROUP BY lang""")
def conditional_body_counts(spark, folder):
    return quality.body_counts(table(spark, folder, "documents"), ["lang"], F.col("text"))


@query("SELECT conv_id, role, turn, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_version(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "role", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return state.last_of(rows, ["conv_id", "role"], ["turn"])


@query("SELECT conv_id, role, (coalesce(max(turn), 0) + 1)::BIGINT AS next_version, count(*)::BIGINT AS n_versions FROM conversations GROUP BY conv_id, role")
def next_version(spark, folder):
    return table(spark, folder, "conversations").groupBy("conv_id", "role").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).cast("long").alias("next_version"), F.count(F.lit(1)).alias("n_versions"))


@query("""WITH v AS (SELECT conv_id, role, turn AS version, true AS is_published FROM conversations), m AS (SELECT conv_id, role, max(version) + 1 AS version FROM v WHERE role = 'user' GROUP BY ALL)
SELECT conv_id, role, version, is_published AND role <> 'user' AS is_published FROM v UNION ALL SELECT conv_id, role, version, true FROM m""")
def publish_versions(spark, folder):
    old = table(spark, folder, "conversations").select("conv_id", "role", F.col("turn").alias("version"), F.lit(True).alias("is_published"))
    return state.publish(old, old.filter("role = 'user'").select("conv_id", "role").distinct(), ["conv_id", "role"])


@query("""SELECT (SELECT count(*) FROM benchmark) AS n_findings, (SELECT count(*) FROM labels) AS n_mappings, (SELECT count(DISTINCT source) FROM labels JOIN documents USING (doc_id)) AS n_clauses_mapped,
  (SELECT count(*) FROM labels) AS n_clauses, (SELECT count(*) FROM labels WHERE quality = 1) AS n_covered""")
def report_summary(spark, folder):
    findings = table(spark, folder, "benchmark").select(F.col("item_id").alias("finding_id"), F.col("text").alias("finding_text"))
    labels = table(spark, folder, "labels")
    mappings = labels.join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("finding_id"), F.col("source").alias("clause_id"), F.col("source").alias("clause_title"), F.lit(58).alias("relevance_pct"))
    coverage = labels.select(F.when(F.col("quality") == 1, "covered").otherwise("not_covered").alias("status"))
    return report(findings, mappings, coverage)["summary"]


@query("SELECT conv_id, md5(lower(string_agg(text, ' ' ORDER BY turn))) AS said_md5 FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def ordered_concat(spark, folder):
    rows = table(spark, folder, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.md5(F.lower(F.array_join(F.transform("t", lambda x: x["text"]), " ")).cast("binary")).alias("said_md5"))


@query("""WITH k AS (SELECT lang AS scope, coalesce(md5(text), '') AS clause_id, * FROM documents)
SELECT scope, clause_id, min(doc_id) AS position, arg_min(source, doc_id) AS title, md5(coalesce(arg_min(text, doc_id) FILTER (WHERE trim(text, E' \\t\\r\\n\\f\\v') <> ''), '')) AS body_md5,
  min(n_chars) AS sort_order, (count(*) - 1)::BIGINT AS n_warnings FROM k GROUP BY scope, clause_id""")
def first_wins_dedupe(spark, folder):
    """Documents of a language keyed by their whole text: the first one's place and source stand, repeats are counted."""
    rows = table(spark, folder, "documents").select(F.col("lang").alias("scope"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("clause_id"), F.col("doc_id").alias("position"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("n_chars").alias("sort_order"))
    found = sections.first_wins(rows, ["scope"])
    return found.select("scope", "clause_id", "position", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "sort_order", "n_warnings")


@query("""SELECT conv_id, turn, count(*) FILTER (WHERE contains(lower(text), w))::BIGINT AS n_terms, bool_or(contains(lower(text), w)) AS allowed
FROM conversations, (SELECT unnest(['onth', 'tion', 'zwei', 'para']) AS w) GROUP BY conv_id, turn""")
def guardrail_filter(spark, folder):
    lower = F.lower("text")
    terms = F.array(*[F.lit(w) for w in ("onth", "tion", "zwei", "para")])
    hit = F.filter(terms, lambda w: F.contains(lower, w))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.size(hit).cast("long").alias("n_terms"), (F.size(hit) > 0).alias("allowed"))


def _snapshots(spark, folder) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.filter("lang <> 'es'"), docs.filter("source like 'src1%'").withColumn("n_chars", F.col("n_chars") + 1).withColumn("source", F.when(F.col("lang") != "de", F.col("source")))


OLD_NEW = """o AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE lang <> 'es'),
n AS (SELECT doc_id, lang, CASE WHEN lang <> 'de' THEN source END AS source, n_chars + 1 AS n_chars FROM documents WHERE source LIKE 'src1%')"""


@query(f"WITH {OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def upsert_last_wins(spark, folder):
    return state.upsert(*_snapshots(spark, folder), ["doc_id"])


@query(f"WITH {OLD_NEW} SELECT doc_id, coalesce(o.lang, n.lang) AS lang, coalesce(n.source, o.source) AS source, coalesce(o.n_chars, n.n_chars) AS n_chars FROM o FULL JOIN n USING (doc_id)")
def partial_upsert(spark, folder):
    return state.upsert_columns(*_snapshots(spark, folder), ["doc_id"], ["source"])


@query(f"WITH {OLD_NEW}, r AS (SELECT * FROM n WHERE lang = 'fr') SELECT * FROM r UNION ALL SELECT * FROM o WHERE lang NOT IN (SELECT lang FROM r)")
def replace_partition(spark, folder):
    old, new = _snapshots(spark, folder)
    return state.replace_scope(old, new.filter("lang = 'fr'"), ["lang"])


@query(f"WITH {OLD_NEW} SELECT * FROM o WHERE NOT (lang = 'de' AND source LIKE 'src1%')")
def purge_scope(spark, folder):
    return state.purge(_snapshots(spark, folder)[0], (F.col("lang") == "de") & F.col("source").startswith("src1"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5))")
def cascade_delete(spark, folder):
    kept = state.cascade(table(spark, folder, "orders"), table(spark, folder, "customer").filter("c_nationkey < 5"), "o_custkey", "c_custkey")
    return state.cascade(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), kept, "l_orderkey", "o_orderkey")


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, json_merge_patch(props, json_object('type', event_type, 'k', '7'))->>'k' AS merged_k, json_merge_patch(props, json_object('type', event_type))->>'type' AS merged_type FROM events""")
def json_merge_patch(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "props", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = state.merge_patch(rows, "props", F.to_json(F.struct(F.col("event_type").alias("type"), F.lit("7").alias("k"))))
    return rows.select("event_id", "k", F.get_json_object("props", "$.k").alias("merged_k"), F.get_json_object("props", "$.type").alias("merged_type"))


@query("""SELECT NULL::VARCHAR AS user_id, 'update' AS action, event_id::VARCHAR AS entity_id, '{"value":1}' AS before_json, '{"kind":"' || event_type || '"}' AS after_json FROM events""")
def audit_rows(spark, folder):
    return state.audit(table(spark, folder, "events"), F.col("user_id").cast("string"), F.lit("update"), F.col("event_id").cast("string"), F.struct(F.lit(1).alias("value")), F.struct(F.col("event_type").alias("kind")))


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL")
def distinct_languages(spark, folder):
    return table(spark, folder, "documents").select("lang").filter("lang is not null").distinct()


@query("""WITH l AS (SELECT source, list(DISTINCT lang) AS a FROM documents WHERE lang IS NOT NULL GROUP BY source)
SELECT source, len(a)::INT AS n, list_contains(a, 'es') AS has_es, len(list_intersect(a, ['en', 'xx']))::INT AS n_both, len(list_filter(a, lambda x: x <> 'en'))::INT AS n_less FROM l""")
def array_set_ops(spark, folder):
    rows = table(spark, folder, "documents").groupBy("source").agg(F.collect_set("lang").alias("a"))
    ask = F.array(F.lit("en"), F.lit("xx"))
    return rows.select("source", F.size("a").alias("n"), F.array_contains("a", "es").alias("has_es"), F.size(F.array_intersect("a", ask)).alias("n_both"), F.size(F.array_except("a", F.array(F.lit("en")))).alias("n_less"))


def _sets(spark, folder) -> tuple[DataFrame, DataFrame]:
    """All English documents and all others, each by its place within its language's documents of a source; whole texts are bodies."""
    own = Window.partitionBy("source", F.col("lang") == "en").orderBy("doc_id")
    docs = table(spark, folder, "documents").select("source", "lang", "text", "n_chars", F.row_number().over(own).cast("string").alias("clause_id"))
    rows = docs.select(F.concat("source", F.lit(":"), "clause_id").alias("clause_id"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.col("n_chars").alias("sort_order"), (F.col("lang") == "en").alias("en"))
    return rows.filter("en").drop("en"), rows.filter("not en").drop("en")


SETS = """s AS (SELECT source || ':' || row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY doc_id) AS clause_id, source AS title, coalesce(text, '') AS body, n_chars AS sort_order, (lang <> 'en')::INT AS f
  FROM documents WHERE lang IS NOT NULL)"""


@query(f"""WITH {SETS} SELECT clause_id, arg_max(title, (title <> 'src1')::INT * 2 - f) AS title, md5(arg_max(body, length(body) * 2 + f)) AS body_md5, min(sort_order) AS sort_order FROM s GROUP BY clause_id""")
def merge_clause_sets(spark, folder):
    rows = sections.merged(*_sets(spark, folder), [], F.col("title") != "src1")
    return rows.select("clause_id", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "sort_order")


@query(f"""WITH {SETS}, c AS (SELECT coalesce(sum(length(trim(body, E' \\t\\n\\r\\f\\v'))) FILTER (WHERE f = 0), 0) AS l, sum(length(trim(body, E' \\t\\n\\r\\f\\v'))) FILTER (WHERE f = 1) AS o, count(*) FILTER (WHERE f = 0) AS nl, count(*) FILTER (WHERE f = 1) AS no FROM s)
SELECT clause_id, title FROM s, c WHERE f = (coalesce(no >= nl AND o >= l * 0.70, false))::INT""")
def choose_best_set(spark, folder):
    return sections.choose(*_sets(spark, folder)).select("clause_id", "title")


@query("""SELECT doc_id, lang, source, contains(lower(source), '1') AS by_source FROM documents WHERE lang = 'en' AND (contains(lower(text), 'station') OR contains(lower(source), '19') OR doc_id::VARCHAR LIKE '%77%')""")
def viewer_search(spark, folder):
    rows = table(spark, folder, "documents").filter("lang = 'en'")
    found = rows.filter(F.contains(F.lower("text"), F.lit("station")) | F.contains(F.lower("source"), F.lit("19")) | F.contains(F.col("doc_id").cast("string"), F.lit("77")))
    return found.select("doc_id", "lang", "source", F.contains(F.lower("source"), F.lit("1")).alias("by_source"))


@query("SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM documents WHERE source LIKE 'src1%') AS n_prefixed, (SELECT count(DISTINCT lang) FROM documents) AS n_langs, (SELECT max(n_chars) FROM documents) AS longest")
def corpus_overview(spark, folder):
    return table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("source").startswith("src1")).alias("n_prefixed"), F.count_distinct("lang").alias("n_langs"), F.max("n_chars").alias("longest"))


@query(r"""SELECT p_partkey, p_name LIKE '%e%' AS has_e, p_type ILIKE '%STEEL%' AS steel, regexp_matches(p_brand, '[1-3]') AS low, lower(p_brand) = lower(upper(p_brand)) AS same, p_size BETWEEN 0 AND 10 AS core FROM part""")
def filter_matrix(spark, folder):
    c = F.col
    return table(spark, folder, "part").select("p_partkey", c("p_name").like("%e%").alias("has_e"), c("p_type").ilike("%STEEL%").alias("steel"), c("p_brand").rlike("[1-3]").alias("low"), (F.lower("p_brand") == F.lower(F.upper("p_brand"))).alias("same"), c("p_size").between(0, 10).alias("core"))


@query("""WITH n AS (SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source)
SELECT source, en::BIGINT AS en, fr::BIGINT AS fr, CASE WHEN en > 10 AND fr < 10 THEN 'en-fr' WHEN fr > 10 AND en < 10 THEN 'fr-en' END AS direction FROM n""")
def lang_gap_direction(spark, folder):
    rows = table(spark, folder, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "fr").alias("fr"))
    return rows.withColumn("direction", F.when((F.col("en") > 10) & (F.col("fr") < 10), "en-fr").when((F.col("fr") > 10) & (F.col("en") < 10), "fr-en"))


@query("SELECT source, max(struct_pack(a := n_chars, b := -doc_id)).a AS n_chars, -max(struct_pack(a := n_chars, b := -doc_id)).b AS doc_id FROM documents GROUP BY source")
def argmax_candidate(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("b"))).alias("m")).select("source", F.col("m.n_chars").alias("n_chars"), (-F.col("m.b")).alias("doc_id"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def sample_limit(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)


@query(r"SELECT page_id, regexp_extract(url, '(20\d{2})', 1) AS edition, lower(regexp_extract(url, '\.([^.]+)$', 1)) AS kind FROM pages")
def edition_extract(spark, folder):
    return table(spark, folder, "pages").select("page_id", ids.edition(F.col("url")).alias("edition"), ids.file_kind(F.col("url")).alias("kind"))


@query("""SELECT event_id, user_id AS prompt_tokens, (value * 10)::BIGINT AS completion_tokens, user_id + (value * 10)::BIGINT AS total_tokens FROM (SELECT event_id, user_id, floor(value) AS value FROM events)""")
def usage_json(spark, folder):
    raw = F.concat(F.lit('{"usage": {"input_tokens": '), F.col("user_id").cast("string"), F.lit(', "output_tokens": '), (F.floor("value") * 10).cast("string"), F.lit("}}"))
    return table(spark, folder, "events").select("event_id", data.usage(raw).alias("u")).select("event_id", "u.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS found FROM events")
def first_json_span(spark, folder):
    text = F.concat(F.lit("reply: "), F.col("props"), F.lit(" done"))
    text = F.when(F.col("event_id") % 3 == 0, F.replace(text, F.lit("}"), F.lit(""))).otherwise(text)
    return table(spark, folder, "events").select("event_id", data.first_object(text).alias("found"))


@query("""SELECT quality, toxic, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic""")
def coverage_report(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return table(spark, folder, "labels").join(docs, "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT s_suppkey, split_part(s_name || '@x.example', '@', 1) AS shown FROM supplier")
def display_name(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", ids.display_name(F.lit("  "), F.concat("s_name", F.lit("@x.example"))).alias("shown"))
