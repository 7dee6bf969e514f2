"""Queries over texts: chunks, terms, search, validation, sections. Each is a function of (spark, folder) with its SQL, if there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import data, ids
from ..functions import text as tx
from ..functions.models import embedder
from ..operators import chunks, quality, search, sections
from ..operators.vector_index import VectorIndex
from ..sources.tables import table
from ..storage import scratch, scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in tx.SEARCH_STOP_WORDS)
PHRASE_STOP = ", ".join(f"'{w}'" for w in tx.PHRASE_STOP_WORDS)
FOUND = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z\x{0590}-\x{05FF}]{4,}')"
TERMS = f"""
w AS (SELECT item_id, unnest({FOUND}) AS w, generate_subscripts({FOUND}, 1) AS i FROM benchmark),
k AS (SELECT item_id, w, min(i) AS i FROM w WHERE w NOT IN ({STOP}) GROUP BY item_id, w),
terms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM k) WHERE r <= 6)"""
CHUNKS = """
chunks AS (SELECT doc_id, lang, (s // 1000)::BIGINT AS chunk_index, substring(t, s + 1, 1200) AS content
           FROM (SELECT doc_id, lang, coalesce(text, '') AS t, unnest(generate_series(0, greatest(length(coalesce(text, '')) - 1, 0), 1000)) AS s FROM documents))"""


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, content FROM chunks")
def chunk_documents(spark, folder):
    return chunks.chunk(_docs(spark, folder).select("doc_id", "text"))


@query(f"WITH {CHUNKS} SELECT lang, count(*)::BIGINT AS n_chunks, count(*) FILTER (WHERE chunk_index > 0 AND length(content) <= 200)::BIGINT AS n_redundant, max(length(content))::BIGINT AS longest FROM chunks GROUP BY lang")
def chunk_stats_by_lang(spark, folder):
    rows = chunks.chunk(_docs(spark, folder).select("lang", "text"))
    n = F.length("content")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if((F.col("chunk_index") > 0) & (n <= 200)).alias("n_redundant"), F.max(n).cast("long").alias("longest"))


@query(f"WITH {TERMS} SELECT item_id, string_agg(w, ',' ORDER BY i) AS terms FROM terms GROUP BY item_id")
def query_terms(spark, folder):
    rows = table(spark, folder, "benchmark").select("item_id", tx.query_terms(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.filter("size(t) > 0").select("item_id", F.array_join("t", ",").alias("terms"))


@query(f"""
WITH {TERMS}, q AS (SELECT item_id, list(w) AS ws FROM terms GROUP BY item_id),
h AS (SELECT item_id, doc_id, length(text) AS n FROM q JOIN documents ON len(list_filter(ws, lambda x: contains(lower(text), x))) > 0)
SELECT item_id AS query_id, doc_id, n::BIGINT AS content_length FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM h) WHERE r = 1""")
def keyword_search_top1(spark, folder):
    return search.keyword_best(_docs(spark, folder), "doc_id", "text", _items(spark, folder))


@query(f"""
WITH {TERMS}, q AS (SELECT item_id, list(w) AS ws FROM terms GROUP BY item_id),
h AS (SELECT item_id, lang, doc_id, length(text) AS n FROM q JOIN documents ON len(list_filter(ws, lambda x: contains(lower(text), x))) > 0)
SELECT item_id AS query_id, lang, doc_id, n::BIGINT AS content_length FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY n DESC, doc_id) AS r FROM h) WHERE r = 1""")
def keyword_scope_isolation(spark, folder):
    """The best row of each language: a scope's rows never answer for another."""
    return search.keyword_best(_docs(spark, folder), "doc_id", "text", _items(spark, folder), ["lang"])


@query(f"""
WITH {TERMS}, q AS (SELECT item_id, list(w) AS ws FROM terms GROUP BY item_id),
h AS (SELECT item_id, doc_id, length(text) AS n FROM q JOIN documents ON len(list_filter(ws, lambda x: contains(lower(text), x))) > 0)
SELECT item_id AS query_id, doc_id, n::BIGINT AS content_length, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM h) WHERE r <= 10""")
def keyword_search_top10(spark, folder):
    return search.keyword_topk(_docs(spark, folder), "doc_id", "text", _items(spark, folder))


NEAR = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, (label + {shift}) % 10 AS scope FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT * FROM (
  SELECT query_id, vec_id, s AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r
  FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings JOIN q ON label = scope)) WHERE r <= {k})"""


def _near(spark, folder, shift: int, k: int) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), ((F.col("label") + shift) % 10).alias("scope"))
    return search.vector_topk(rows, "vec_id", "embedding", queries, k, {"label": "scope"})


@query(f"WITH {NEAR.format(shift=0, k=5)} SELECT query_id, vec_id, r::INT AS rank, round(similarity, 6) AS similarity FROM near")
def vector_topk_scoped(spark, folder):
    return _near(spark, folder, 0, 5).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {NEAR.format(shift=1, k=1)}
SELECT query_id, vec_id, greatest(1, round_even(similarity * 10, 0)::INT) AS score, least(95, greatest(50, round_even(similarity * 100, 0)::INT)) AS relevance_pct FROM near WHERE similarity >= 0.25""")
def vector_threshold_score(spark, folder):
    near = _near(spark, folder, 1, 1).filter(F.col("similarity") >= search.SIMILARITY)
    return near.select("query_id", "vec_id", data.score(F.col("similarity")).alias("score"), data.relevance(F.col("similarity")).alias("relevance_pct"))


@query(f"""WITH {NEAR.format(shift=1, k=1)}, {TERMS}, qs AS (SELECT item_id, list(w) AS ws FROM terms GROUP BY item_id),
h AS (SELECT item_id, doc_id, length(text) AS n FROM qs JOIN documents ON len(list_filter(ws, lambda x: contains(lower(text), x))) > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM h) WHERE r = 1),
v AS (SELECT query_id, 'vector' AS branch, vec_id AS hit, least(95, greatest(50, round_even(similarity * 100, 0)::INT)) AS relevance_pct FROM near WHERE similarity >= 0.25)
SELECT * FROM v UNION ALL
SELECT q.query_id, 'keyword', b.doc_id, 58 FROM q JOIN b ON q.query_id % 40 = b.item_id WHERE q.query_id NOT IN (SELECT query_id FROM v)""")
def search_with_fallback(spark, folder):
    near = _near(spark, folder, 1, 1).withColumnRenamed("vec_id", "hit")
    best = search.keyword_best(_docs(spark, folder), "doc_id", "text", _items(spark, folder)).select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("hit"))
    asked = table(spark, folder, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 40).alias("item_id"))
    return search.with_fallback(near, asked.join(best, "item_id").select("query_id", "hit"))


INDEXED = """exact AS (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r, s AS similarity
  FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q))"""


def _indexed(spark, folder, probes: int | None) -> DataFrame:
    """A stored index of all vectors, and every fiftieth asked. The index is removed when its answers are written."""
    rows = table(spark, folder, "embeddings")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    with scratch(spark, "index") as path:
        index = VectorIndex.build(rows, "vec_id", "embedding", path, lists=20)
        if probes == 0:
            some = rows.filter("vec_id % 50 = 25").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
            probes = index.probes_for("vec_id", "embedding", some, 10)
        out = scratch_path(spark, "answers")
        index.search("vec_id", "embedding", queries, 10, probes=probes).write.parquet(out)
    return spark.read.parquet(out).select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query(f"WITH {INDEXED} SELECT query_id, r::INT AS rank, round(similarity, 5) AS similarity FROM exact WHERE r <= 10")
def vector_index_exact(spark, folder):
    """All lists of the index probed: the exact answer, by similarity."""
    return _indexed(spark, folder, None).drop("vec_id")


@query()
def vector_index_topk(spark, folder):
    """The nearest lists alone, as many as other queries needed for 95 % of their exact hits."""
    return _indexed(spark, folder, 0)


@query(f"""WITH {NEAR.format(shift=1, k=1)}, {TERMS}, qs AS (SELECT item_id, list(w) AS ws FROM terms GROUP BY item_id),
h AS (SELECT item_id, doc_id, length(text) AS n FROM qs JOIN documents ON len(list_filter(ws, lambda x: contains(lower(text), x))) > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM h) WHERE r = 1),
v AS (SELECT query_id AS finding, 'vector' AS branch, vec_id AS clause, least(95, greatest(50, round_even(similarity * 100, 0)::INT)) AS relevance_pct FROM near WHERE similarity >= 0.25),
a AS (SELECT * FROM v UNION ALL SELECT q.query_id, 'keyword', b.doc_id, 58 FROM q JOIN b ON q.query_id % 40 = b.item_id WHERE q.query_id NOT IN (SELECT finding FROM v))
SELECT *, 'minor' AS severity, finding % 100 <> 0 AS inserted FROM a""")
def auto_map_vectors(spark, folder):
    """Findings mapped to sections by vectors first and by keywords where those find nothing; what is mapped already is proposed but not inserted."""
    near = _near(spark, folder, 1, 1).withColumnRenamed("vec_id", "hit")
    best = search.keyword_best(_docs(spark, folder), "doc_id", "text", _items(spark, folder)).select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("hit"))
    asked = table(spark, folder, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 40).alias("item_id"))
    known = asked.filter("query_id % 100 = 0").select(F.col("query_id").alias("finding"))
    return search.auto_mapped(near, asked.join(best, "item_id").select("query_id", "hit"), known)


@query(f"""
WITH {TERMS}, q AS (SELECT item_id, list(w) AS ws FROM terms GROUP BY item_id),
h AS (SELECT item_id, doc_id, length(text) AS n FROM q JOIN documents ON lang = 'en' AND len(list_filter(ws, lambda x: contains(lower(text), x))) > 0)
SELECT item_id, doc_id, 58 AS relevance_pct, 'minor' AS severity, item_id % 4 <> 0 AS inserted FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM h) WHERE r = 1""")
def auto_map_relevance(spark, folder):
    """Every fourth item is mapped already: its proposal counts but isn't inserted."""
    best = search.keyword_best(_docs(spark, folder).filter("lang = 'en'"), "doc_id", "text", _items(spark, folder))
    known = table(spark, folder, "benchmark").filter("item_id % 4 = 0").select("item_id", F.lit(True).alias("known"))
    rows = best.select(F.col("query_id").alias("item_id"), "doc_id", data.keyword_relevance(F.lit(1)).alias("relevance_pct"), F.lit("minor").alias("severity"))
    return rows.join(known, "item_id", "left").withColumn("inserted", F.col("known").isNull()).drop("known")


SAMPLE = r"""
d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS row, count(*) OVER () AS n FROM documents WHERE regexp_replace(coalesce(text, ''), '\s', '', 'g') <> ''),
s AS (SELECT doc_id, text, row FROM d WHERE row % greatest(1, n // 20) = 0 AND row / greatest(1, n // 20) < 20)"""


@query(f"WITH {SAMPLE} SELECT doc_id, row::BIGINT AS row FROM s")
def systematic_sample(spark, folder):
    docs = _docs(spark, folder)
    return quality.systematic(docs.filter(~tx.blank(F.col("text"))).select("doc_id"), "doc_id").select("doc_id", "row")


PAIRS = f"""
pw AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
       FROM (SELECT doc_id, unnest({FOUND}) AS w, generate_subscripts({FOUND}, 1) AS i FROM @source) WHERE w NOT IN ({PHRASE_STOP})),
pp AS (SELECT a.doc_id, a.w || ' ' || b.w AS p, min(a.i) AS i FROM pw a JOIN pw b ON a.doc_id = b.doc_id AND b.i = a.i + 1 GROUP BY 1, 2),
pairs AS (SELECT doc_id, p, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM pp) WHERE r <= 4)"""


@query(f"WITH {PAIRS.replace('@source', 'documents')} SELECT doc_id, string_agg(p, ',' ORDER BY i) AS pairs FROM pairs GROUP BY doc_id")
def key_bigrams(spark, folder):
    rows = _docs(spark, folder).select("doc_id", tx.key_bigrams(F.coalesce("text", F.lit(""))).alias("p"))
    return rows.filter("size(p) > 0").select("doc_id", F.array_join("p", ",").alias("pairs"))


@query(f"""WITH {SAMPLE}, {PAIRS.replace('@source', 's')}, {CHUNKS},
j AS (SELECT doc_id, lower(string_agg(content, ' ' ORDER BY chunk_index)) AS said FROM chunks JOIN documents USING (doc_id) WHERE source <> 'src1' GROUP BY doc_id),
c AS (SELECT (SELECT count(*) FROM s) AS n_sampled, (SELECT count(*) FROM s JOIN j USING (doc_id)) AS n_found,
             (SELECT count(*) FROM pairs JOIN j USING (doc_id)) AS n_phrases, (SELECT count(*) FROM pairs JOIN j USING (doc_id) WHERE contains(said, p)) AS n_phrases_found),
r AS (SELECT *, round(n_found / greatest(1, n_sampled), 3) AS rag_hit_rate, round(n_phrases_found / greatest(1, n_phrases), 3) AS phrase_hit_rate FROM c)
SELECT *, rag_hit_rate >= 0.8 AND phrase_hit_rate >= 0.7 AS passed FROM r""")
def validation_report(spark, folder):
    """An import of which one source's chunks are missing."""
    sample = quality.sampled(_docs(spark, folder), "doc_id", "text")
    index = chunks.chunk(sample.filter("source <> 'src1'").select("doc_id", "text"))
    return quality.validate(sample, index, "doc_id", "text")


HEADS = """
l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"""


@query(f"""WITH {HEADS},
c AS (SELECT *, CASE WHEN length(line) < 40 THEN line END AS own FROM l),
h AS (SELECT doc_id, last_value(own IGNORE NULLS) OVER w AS head, count(own) OVER w AS section FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, section::BIGINT AS section, max(head) AS head, count(*)::BIGINT AS n_lines FROM h WHERE head IS NOT NULL GROUP BY doc_id, section""")
def heading_carry_forward(spark, folder):
    """Lines of under 40 characters stand for headings, of which these texts have no others."""
    rows = sections.lines(_docs(spark, folder), "doc_id", F.coalesce("text", F.lit("")))
    rows = sections.carried(rows.withColumn("own", F.when(F.length("line") < 40, F.col("line"))), "doc_id", F.col("own"))
    return rows.filter("head is not null").groupBy("doc_id", "section").agg(F.max("head").alias("head"), F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH {HEADS},
o AS (SELECT *, length(line) < 40 AS open, lead(line) OVER w AS next, lead(length(line) < 40) OVER w AS next_open, lag(length(line) < 40, 1, false) OVER w AS taken FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no::INT AS line_no, CASE WHEN open AND next IS NOT NULL AND NOT coalesce(next_open, true) THEN line || ' ' || next ELSE line END AS line FROM o WHERE NOT taken OR open""")
def next_line_join(spark, folder):
    rows = sections.lines(_docs(spark, folder), "doc_id", F.coalesce("text", F.lit("")))
    return sections.joined_next(rows, "doc_id", F.length("line") < 40)


DOTTED = "SELECT DISTINCT l_orderkey AS scope, (l_orderkey % 12)::VARCHAR || '.' || l_linenumber || '.' || (l_suppkey % 100) AS clause_id FROM lineitem"


def _dotted(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.select(F.col("l_orderkey").alias("scope"), F.concat_ws(".", (F.col("l_orderkey") % 12).cast("string"), F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 100).cast("string")).alias("clause_id")).distinct()


@query(f"""WITH i AS (SELECT *, string_split(clause_id, '.') AS p FROM ({DOTTED}))
SELECT scope, clause_id, p[1]::BIGINT * 100000000 + p[2]::BIGINT * 1000000 + p[3]::BIGINT * 10000 AS sort_order, 3 AS depth, p[1] || '.' || p[2] AS parent_id FROM i""")
def sort_key_depth_parent(spark, folder):
    c = F.col("clause_id")
    return _dotted(spark, folder).select("scope", "clause_id", ids.sort_key(c).alias("sort_order"), ids.depth(c).alias("depth"), ids.parent_id(c).alias("parent_id"))


@query("SELECT DISTINCT l_linenumber, '0' || l_linenumber || '.00' || (l_suppkey % 10) || '.' AS raw, l_linenumber::VARCHAR || '.' || (l_suppkey % 10) AS clause_id FROM lineitem")
def normalize_id(spark, folder):
    raw = F.concat(F.lit("0"), F.col("l_linenumber").cast("string"), F.lit(".00"), (F.col("l_suppkey") % 10).cast("string"), F.lit("."))
    return table(spark, folder, "lineitem").select("l_linenumber", raw.alias("raw")).distinct().withColumn("clause_id", ids.normal_id(F.col("raw")))


@query(f"""WITH i AS ({DOTTED}), s AS (SELECT scope, string_split(clause_id, '.') AS p FROM i),
a AS (SELECT scope, p[1] AS clause_id FROM s UNION SELECT scope, p[1] || '.' || p[2] FROM s)
SELECT scope, clause_id FROM i UNION ALL SELECT scope, clause_id FROM a""")
def ancestor_synthesis(spark, folder):
    rows = _dotted(spark, folder).select("scope", "clause_id", F.lit("t").alias("title"), F.lit("b").alias("body"), ids.sort_key(F.col("clause_id")).alias("sort_order"))
    return sections.with_ancestors(rows, ["scope"]).select("scope", "clause_id")


@query(f"""WITH i AS ({DOTTED}), s AS (SELECT *, string_split(clause_id, '.') AS p FROM i)
SELECT scope, p[1] || '.' || p[2] AS clause_id, string_agg(clause_id || ' t' || chr(10) || chr(10) || 'b', chr(10) || chr(10) ORDER BY p[3]::INT, clause_id) AS body FROM s GROUP BY ALL""")
def rollup_children(spark, folder):
    rows = _dotted(spark, folder).select("scope", "clause_id", F.lit("t").alias("title"), F.lit("b").alias("body"), ids.sort_key(F.col("clause_id")).alias("sort_order"))
    return sections.rolled_up(sections.with_ancestors(rows, ["scope"]), ["scope"]).filter(ids.depth(F.col("clause_id")) == 2).select("scope", "clause_id", "body")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM (SELECT doc_id, replace(coalesce(text, ''), chr(13), chr(10)) AS text FROM documents)),
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(line, '[ \t]+', ' ', 'g'), '^ | $', '', 'g') AS line FROM l)
SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '')) AS text_md5 FROM c GROUP BY doc_id""")
def normalize_text(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(tx.collapsed(F.coalesce("text", F.lit(""))).cast("binary")).alias("text_md5"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '(?i)((©|\(c\))\s*ISO|All rights reserved|Licensed to|ANSI order|Downloaded \d|^\s*ISO\s*\d|\d\s+\d\s+\d\s+\d\s+\d)'))::BIGINT AS n_junk FROM l GROUP BY doc_id""")
def junk_filter(spark, folder):
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return _docs(spark, folder).select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(tx.JUNK_PARAGRAPH))).cast("long").alias("n_junk"))


@query(r"""SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')))::BIGINT AS n_tokens,
  greatest(1024, least(8192, ceil((floor(length(coalesce(text, '')) * 1.2::DOUBLE)::BIGINT + 256) / 3)))::BIGINT AS budget FROM documents""")
def token_estimate(spark, folder):
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, folder).select("doc_id", tx.token_estimate(t).cast("long").alias("n_tokens"), tx.token_budget(t).alias("budget"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, from_base64(base64(encode(coalesce(text, '')))) = encode(coalesce(text, '')) AS same FROM documents")
def content_hash(spark, folder):
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return _docs(spark, folder).select("doc_id", F.sha2(raw, 256).alias("sha256"), (F.unbase64(F.base64(raw)) == raw).alias("same"))


@query(r"""WITH f AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS t, string_split(coalesce(text, ''), ' ')[1] AS c FROM documents)
SELECT doc_id, length(t) >= 2 AND regexp_matches(t, '[A-Za-z]') AS has_letters, regexp_matches(t, '^[a-z]') AS starts_small, regexp_matches(t, '[;,]$') AS open_ended, contains(t, c) AS holds_first FROM f""")
def title_predicates(spark, folder):
    t, c = F.split(F.coalesce("text", F.lit("")), "\n", -1)[0], F.split(F.coalesce("text", F.lit("")), " ", -1)[0]
    return _docs(spark, folder).select("doc_id", ((F.length(t) >= 2) & t.rlike("[A-Za-z]")).alias("has_letters"), t.rlike("^[a-z]").alias("starts_small"), t.rlike("[;,]$").alias("open_ended"), F.contains(t, c).alias("holds_first"))


@query()
def section_parse(spark, folder):
    """Numbered sections of texts whose lines are given numbers; checked in the tests."""
    numbered = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line, i: F.concat((i % 9 + 1).cast("string"), F.lit(" Heading here\n"), line)), "\n")
    found = sections.parse(_docs(spark, folder).select("doc_id", numbered.alias("text")))
    return sections.rolled_up(sections.with_ancestors(sections.first_wins(found, ["doc_id"]), ["doc_id"]), ["doc_id"])


@query()
def embed_seam(spark, folder):
    """Chunks with vectors of the offline embedder; failed ones are null."""
    rows = chunks.chunk(_docs(spark, folder).select("doc_id", "text"))
    rows = rows.withColumn("embedding", embedder()(F.col("content")))
    return rows.withColumn("embedding", F.when(~data.is_failed_embedding(F.col("embedding")), F.col("embedding"))).drop("content")
