"""Spelling variants: words one edit apart, found by merging the light subtrees of their trie.

Words are runs of letters, counted over whole texts; occurrences that a hash of
document and word selects lose one letter. A word is near another where one inserted,
deleted or replaced code point makes the one the other, its form is the near word
of most occurrences if those are twice its own or more, and its root is where the forms lead.

All words make one trie. At a node the child with most words below it is heavy, the other
edges and a word's end are light; a word has a logarithm of the number of words of light edges
at most. Two near words part at one node, where one of the two goes by a light edge. So only
light subtrees are copied (small to large), with their first letter skipped, replaced by the heavy
child's or put behind it, into what lies under the node and its heavy child; terminals that coincide
are near pairs. Subtrees that are both light meet among themselves with a wildcard in that place.
Every pair is found at one node and in one way, so counts need no comparison of pairs.

As Spark jobs: a node is a hash of a prefix, so a word of L letters is L + 1 thin rows; counts
by (node, letter) give the heavy letters of branching nodes; joined with the words' paths these
leave the light edges; the copies are strings that are joined with the words. Equal hashes of
different prefixes cost nothing but time: whatever letter a node calls heavy, one edge of two is light.
Wildcard groups hold a word for each letter of the alphabet at most and are reduced to
their size and two best members; no pairs within them are made.

Defined cases: null and empty texts have no words; a null doc_id hashes as the empty
string; repeated rows count repeatedly; no words give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, shuffled, table, written
from .importance import CRC_TABLE, crc_sql
from .textkernel import mix, powers

LEAST_LETTERS, LEAST_TIMES, SLIPS = 5, 3, 97
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 1 << 19
END = -1

_LETTERS = re.compile("[a-zÀ-ÿ]+")
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _counted(batches: Iterator[pa.RecordBatch], least: int, slips: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            folded = text.as_buffer().to_pybytes().translate(_FOLD).decode()
            begun = crc32(f"{doc_id}:".encode())
            for word, n in Counter(map(re.Match.group, _LETTERS.finditer(folded))).items():
                if len(word) < least:
                    continue
                h = crc32(word.encode(), begun)
                if h % slips == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                held[word] += n
            if len(held) > HELD_WORDS:
                yield given()
                held.clear()
    yield given()


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_TIMES, slips: int = SLIPS) -> DataFrame:
    """id, word, n of the words that occur often enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = rows.mapInArrow(lambda b: _counted(b, least, slips), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.filter(F.col("n") >= times).withColumn("id", F.monotonically_increasing_id()), "words")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        up, down = powers(max(1, len(letters)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(letters) * up[: len(letters)])])
        row = np.repeat(np.arange(len(words)), size + 1)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        first = begin[row]
        # of an empty prefix the place of the last word may lie behind all letters, where there is no power
        node = mix((total[first + pos] - total[first]) * down[np.minimum(first, len(down) - 1)] + pos.astype(np.uint64))
        edge = np.where(pos < size[row], np.append(letters, 0).astype(np.int64)[np.minimum(first + pos, len(letters))], END)
        columns = {"id": batch.column("id").take(pa.array(row)), "pos": pa.array(pos, pa.int32()), "node": pa.array(node.view(np.int64)), "edge": pa.array(edge, pa.int32())}
        yield pa.RecordBatch.from_pydict(columns)


def paths(words: DataFrame) -> DataFrame:
    """id, pos, node, edge: the nodes that a word goes through and the letter it leaves each by, END at the last."""
    return words.select("id", "word").mapInArrow(_paths, "id long, pos int, node long, edge int")


def branches(words: DataFrame) -> DataFrame:
    """node, heavy: the letter of the heavy child of the nodes with more than one edge."""
    edges = paths(words).groupBy("node", "edge").agg(F.count(F.lit(1)).alias("below"))
    child = F.when(F.col("edge") != END, F.struct("below", "edge"))
    nodes = edges.groupBy("node").agg(F.max(child).alias("most"), F.count(F.lit(1)).alias("edges"))
    return written(nodes.filter("edges > 1").select("node", F.col("most.edge").alias("heavy")), "branches")


def light_edges(words: DataFrame) -> DataFrame:
    """word, n, pos, heavy, ends for each light edge of a word."""
    found = lookup(paths(words), branches(words), ["node"]).filter(F.col("edge") != F.col("heavy"))
    own = found.groupBy("id").agg(F.collect_list(F.struct("pos", "heavy", (F.col("edge") == END).alias("ends"))).alias("light"))  # a logarithm of the words at most
    return words.join(shuffled(own), "id").select("word", "n", F.explode("light").alias("l")).select("word", "n", "l.*")


def near(words: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """word, n_near, best (less its occurrences, the word): how many near words, and the first of them."""
    char = lambda i: F.substr("word", i, F.lit(1))
    pos, heavy = F.col("pos"), F.chr(F.col("heavy"))
    before, rest, after = F.substr("word", F.lit(1), pos), F.substr("word", pos + 1), F.substr("word", pos + 2)
    skipped = F.when(~F.col("ends") & (char(pos + 1) != char(pos + 2)), F.concat(before, after))
    behind = F.concat(before, heavy, rest)
    replaced = F.when(~F.col("ends"), F.concat(before, heavy, after))
    wild = F.when(~F.col("ends"), F.concat(before, F.lit("*"), after))
    light = written(light_edges(words).select("word", "n", F.array(skipped, behind, replaced).alias("copies"), wild.alias("wild")), "light")

    copies = light.select(F.col("word").alias("from"), F.col("n").alias("from_n"), F.explode("copies").alias("word")).filter(F.length("word") >= least)
    met = copies.join(shuffled(words.select("word", "n")), "word")
    first = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))
    both = F.array(F.struct(F.col("word"), first("from_n", "from").alias("best")), F.struct(F.col("from").alias("word"), first("n", "word").alias("best")))
    one = met.select(F.explode(both).alias("b")).select("b.word", "b.best", F.lit(1).cast("long").alias("k"))

    crowd = light.filter("wild is not null").groupBy("wild").agg(F.sort_array(F.collect_list(first("n", "word"))).alias("each")).filter("size(each) > 1")  # a word a letter at most
    members = crowd.select(F.explode("each").alias("m"), F.col("each")[0].alias("a"), F.col("each")[1].alias("b"), (F.size("each") - 1).cast("long").alias("k"))
    other = members.select("m.word", F.when(F.col("m.word") == F.col("a.word"), F.col("b")).otherwise(F.col("a")).alias("best"), "k")
    return one.unionByName(other).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where following `form` ends. Each round doubles the steps; forms occur twice as often, so chains are short."""
    known = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(lookup(known, written(further, "further"), ["root"], "left"), "roots")
        known = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.filter("further is not null").isEmpty():
            return known


def variants(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_TIMES, slips: int = SLIPS) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, least, times, slips)
    told = words.join(shuffled(near(words, least)), "word", "left").withColumn("m", -F.col("best.less"))
    strong: Column = F.col("m") >= 2 * F.col("n")
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, F.col("m")).alias("form_n")), "forms")
    found = told.join(shuffled(roots(told.filter("form is not null"))), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
r AS (
  SELECT doc_id, s, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS s FROM documents)
  GROUP BY doc_id, s),
m AS (SELECT s, k, doc_id || ':' || s AS told FROM r WHERE length(s) >= {LEAST_LETTERS}),
h AS (SELECT s, k, {crc_sql("told")} AS h FROM m, crc),
slip AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN left(s, h % length(s)) || substr(s, h % length(s) + 2) ELSE s END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM slip WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_TIMES}),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS c FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.c = b.c AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = cut.c
  UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.c),
near AS (SELECT a AS word, count(*) AS n_near FROM pairs GROUP BY a),
best AS (SELECT a AS word, b, n AS m FROM pairs JOIN w ON w.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
f AS (SELECT w.word, n, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, coalesce(near.n_near, 0) AS n_near, f.form_n
FROM f JOIN walk USING (word) JOIN f AS e ON e.word = walk.at AND e.form IS NULL LEFT JOIN near ON near.word = f.word
"""
