"""Queries of the stored index, of evaluation on a grid and of ids of any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import natural_key, sortable
from ..operators import chunks, indexing, metrics, quality
from ..sources.tables import table
from ..storage import scratch_path
from .text import CHUNKS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


INDEX = f"""{CHUNKS},
stored AS (
  SELECT lang AS collection_id, doc_id::VARCHAR AS source_path, chunk_index, CASE WHEN doc_id % 5 = 1 THEN content || '!' ELSE content END AS t FROM chunks WHERE doc_id % 7 <> 0
  UNION ALL SELECT lang, 'gone/' || doc_id, chunk_index, content FROM chunks WHERE doc_id % 11 = 0),
fresh AS (SELECT lang AS collection_id, doc_id::VARCHAR AS source_path, chunk_index, content AS t FROM chunks)"""


def _index(spark, folder):
    """An index as it was, where some sources have changed, some are missing and some are gone since, and the chunks as they are."""
    fresh = chunks.chunk(table(spark, folder, "documents").select("doc_id", F.col("lang").alias("collection_id"), "text"))
    told = lambda df, path, content: df.select(
        "collection_id", path.alias("source_path"), "chunk_index", content.alias("content"), indexing.content_sha(content).alias("content_sha"), F.create_map().cast("map<string,string>").alias("metadata")
    )
    doc, content = F.col("doc_id"), F.col("content")
    was = told(fresh.filter(doc % 7 != 0), doc.cast("string"), F.when(doc % 5 == 1, F.concat(content, F.lit("!"))).otherwise(content))
    was = was.unionByName(told(fresh.filter(doc % 11 == 0), F.concat(F.lit("gone/"), doc.cast("string")), content))
    return was.withColumn("embedding", F.array_repeat(F.lit(2.0).cast("float"), 64)), told(fresh, doc.cast("string"), content)


@query(f"""WITH {INDEX}
SELECT coalesce(f.collection_id, s.collection_id) AS collection_id, coalesce(f.source_path, s.source_path) AS source_path, coalesce(f.chunk_index, s.chunk_index) AS chunk_index,
  CASE WHEN f.t IS NULL THEN 'deleted' WHEN f.t = s.t THEN 'kept' WHEN f.t IN (SELECT t FROM stored) THEN 'moved' WHEN s.t IS NULL THEN 'new' ELSE 'changed' END AS change
FROM fresh f FULL JOIN stored s ON f.collection_id = s.collection_id AND f.source_path = s.source_path AND f.chunk_index = s.chunk_index""")
def index_changes(spark, folder):
    """What became of each chunk since the index was made."""
    return indexing.changes(*_index(spark, folder))


@query(f"""WITH {INDEX}
SELECT collection_id, source_path, chunk_index, sha256(t) AS content_sha, t IN (SELECT t FROM stored) AS reused FROM fresh""")
def index_refreshed(spark, folder):
    """The next snapshot, published and read again: which chunks have the vector of the last one."""
    stored, fresh = _index(spark, folder)
    store = indexing.ChunkStore(spark, scratch_path(spark, "store"))
    store.publish(stored)
    store.publish(indexing.refreshed(store.read(), fresh))
    return store.read().select("collection_id", "source_path", "chunk_index", "content_sha", F.coalesce(F.col("embedding")[0] == 2.0, F.lit(False)).alias("reused"))


@query("""WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, event_id, value FROM events), b AS (SELECT date_trunc('day', min(ts)) AS s, date_trunc('day', max(ts)) AS e FROM e),
g AS (SELECT unnest(generate_series(s, e, INTERVAL 6 HOUR)) AS t FROM b)
SELECT strftime(t, '%Y-%m-%d %H') AS step, user_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM g JOIN e ON ts <= t AND ts > t - INTERVAL 10 HOUR GROUP BY ALL""")
def range_grid(spark, folder):
    """Series on a grid of six hours with ten hours to look back: a sample counts at one step or two, and gaps stay gaps."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts"))).first()
    found = metrics.stepped(rows, ["user_id"], F.lit(first), F.lit(last), "6 hours", "10 hours")
    return found.select(F.date_format("at", "yyyy-MM-dd HH").alias("step"), "user_id", "value")


@query("""WITH c AS (SELECT doc_id, (doc_id % 13) || '.' || (n_chars % 101) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || (doc_id * 7919 % 1000003) || '.0' || (doc_id % 9) || '.1.2' ELSE '.1' || lpad(doc_id::VARCHAR, 24, '0') END AS clause_id FROM documents)
SELECT doc_id, clause_id, len(string_split(clause_id, '.'))::INT AS n_parts, row_number() OVER (ORDER BY list_transform(string_split(clause_id, '.'), lambda p: p::HUGEINT), doc_id) - 1 AS row FROM c""")
def natural_order(spark, folder):
    """Ids of up to six parts, some of 25 digits, numbered in their natural order."""
    doc, text = F.col("doc_id"), lambda c: c.cast("string")
    deep = F.concat(F.lit("."), text(doc * 7919 % 1000003), F.lit(".0"), text(doc % 9), F.lit(".1.2"))
    tail = F.when(doc % 3 == 0, "").when(doc % 3 == 1, deep).otherwise(F.concat(F.lit(".1"), F.lpad(text(doc), 24, "0")))
    rows = table(spark, folder, "documents").select("doc_id", F.concat(text(doc % 13), F.lit("."), text(F.col("n_chars") % 101), tail).alias("clause_id"))
    told = rows.withColumn("_key", sortable(F.col("clause_id"))).withColumn("n_parts", F.size(natural_key(F.col("clause_id"))))
    return quality.ranked(told, [F.col("_key"), F.col("doc_id")], scratch_path(spark, "ranked")).select("doc_id", "clause_id", "n_parts", "row")
