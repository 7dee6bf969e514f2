"""Resampling, spelling variants and the subword classifier against plain versions, over cases that data may bring."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import importance, spelling, subword
from corpusmill.llm.textkernel import Powers

DOCS = "doc_id long, text string, lang string, score long, word string, _id string"
rng = random.Random(11)
STEMS = ["house", "mouse", "bread", "river", "stone", "tree", "été", "garçon", "straße", "light"]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def typo(word: str) -> str:
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + "e" + word[at:], word[:at] + "a" + word[at + 1 :]])


def text(n: int) -> str:
    return " ".join(typo(w) if rng.random() < 0.2 else w for w in (rng.choice(STEMS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n)))


TEXTS = [None, "", " \n\t", "one", "House HOUSE house", "x" * 30000, "12,3 a.b É é \U0001f600 ×÷", *[text(rng.randint(5, 60)) for _ in range(150)], text(20000)]
ROWS = [(i, t, None, 1, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, text(30), "en", 1, None, None)] * 3 + [(7, TEXTS[7], None, 1, "clash", "clash")] * 2


def saved(spark, tmp_path_factory, rows, labels=(), benchmark=()):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory, ROWS, benchmark=[(1, "river stones and houses"), (2, None), (3, "the river")])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory, [])


def split_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def runs(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def resampled(rows, items, n=1, m=10_000, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of each row, plainly."""
    bucket = lambda f: zlib.crc32(f.encode()) % m
    feats = [[bucket(f) for f in runs(split_words(t), n)] for _, t in rows]
    s, t = Counter(b for f in feats for b in f), Counter(bucket(f) for x in items for f in runs(split_words(x), n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + m) / ((s[b] + 1) * (T + m))))
    out = []
    for (doc_id, body), f in zip(rows, feats, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split_words(body))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def whole(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, folder, n):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    found = importance.resample(docs, items, n=n, buckets=500, percent=50).select("doc_id", "n_features", "weight", "score", "rank")
    plain = resampled([r[:2] for r in ROWS], ["river stones and houses", None, "the river"], n, 500, percent=50)
    assert whole(map(tuple, found.collect())) == whole(plain)


def test_resampling_query(spark, folder):
    found = importance.op11_crc_ring(spark, folder)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in found.dtypes} == {"bigint"}
    assert whole(map(tuple, found.collect())) == whole(resampled([r[:2] for r in ROWS], ["river stones and houses", None, "the river"]))


def test_resampling_of_a_large_share_of_equal_rows(spark):
    rows = [(5, "word " * 25)] * 400 + [(i, text(25)) for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = importance.resample(docs, docs.limit(0), percent=100)
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 601))


def test_ring_in_pieces():
    body = (" ".join(text(200).split()) + " end").encode()
    for n in (1, 2, 5):
        ring = importance.Ring(n)
        in_pieces = [c for piece in importance.pieces(body, 50) for c in ring.take(piece)]
        assert in_pieces == importance.Ring(n).take(body.translate(importance._FOLD).split())
        assert Counter(in_pieces) == Counter(zlib.crc32(f.encode()) for f in runs(split_words(body.decode()), n))


def slipped(doc_id, word: str) -> str:
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def spelled(n: dict[str, int]):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: best[w] if w in best and n[best[w]] >= 2 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_variants(spark, folder):
    n = Counter()
    for doc_id, t, *_ in ROWS:
        n.update(slipped(doc_id, w) for w in re.findall("[a-zÀ-ÿ]+", (t or "").translate(FOLD)))
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    found = spelling.op12_errata_trie(spark, folder)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(n) and set(rows) == spelled(n)
    assert sum(1 for r in rows if r[1]) > 20 and any(r[2] != r[1] for r in rows if r[1])


@pytest.mark.parametrize("letters", ["ab", "aé"])
def test_near_words_of_dense_tries(spark, letters):
    """Few letters: nodes of both children, runs of one letter, words that begin others."""
    made = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(120)} | {letters[0] * k for k in range(5, 12)} | {letters[0] * 3000, letters[0] * 3001}
    words = spark.createDataFrame([(i, w, rng.randint(3, 50)) for i, w in enumerate(sorted(made))], "id long, word string, n long")
    n = {r["word"]: r["n"] for r in words.collect()}
    found = {r["word"]: (r["n_near"], r["best"]["word"], -r["best"]["less"]) for r in spelling.near(words).collect()}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    want = {w: (len(v), min(v, key=lambda x: (-n[x], x)), max(n[x] for x in v)) for w, v in near.items() if v}
    assert found == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abß×ÿ", min_size=1, max_size=12), min_size=1, max_size=20))
def test_paths_name_prefixes(words):
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(words)), pa.int64()), "word": pa.array(words)})
    (found,) = spelling._paths(iter([batch]))
    named = {}
    for row, pos, node, edge in zip(*(found.column(c).to_pylist() for c in ("id", "pos", "node", "edge")), strict=True):
        word = words[row]
        assert edge == (ord(word[pos]) if pos < len(word) else spelling.END)
        assert named.setdefault(word[:pos], node) == node
    assert len(set(named.values())) == len(named)


def plain_features(t: str, buckets: int) -> Counter:
    """The buckets of words, pairs and n-grams of one text: n-grams begin and end anywhere, white space is at an end alone."""
    tables, out = Powers(), Counter()
    raw = np.frombuffer(t.encode(), np.uint8)
    for bucket, _ in subword.features(raw, np.array([0, len(raw)]), tables, buckets):
        out.update(bucket.tolist())
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab é\n*", max_size=12), min_size=1, max_size=8))
def test_features_of_many_texts_are_those_of_each(texts):
    column = pa.array(texts)
    raw, at = subword.text_buffer(column)
    found = [Counter() for _ in texts]
    for bucket, row in subword.features(raw[at[0] : at[-1]], at - at[0], Powers(), 1 << 16):
        for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
            found[r][b] += 1
    for t, f in zip(texts, found, strict=True):
        assert f == plain_features(t, 1 << 16)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        code = re.sub(r"[\x20\x09-\x0D]", " ", t)
        grams = [code[i : i + n] for n in (2, 3, 4) for i in range(len(code) - n + 1)]
        grams = [g for g in grams if " " not in g[1:-1] and not (g[0] == g[-1] == " ")]
        assert sum(f.values()) == len(words) + max(0, len(words) - 1) + len(grams)
        assert len(f) <= len(set(words)) + len({p if p[0] != p[1] else 0 for p in zip(words, words[1:], strict=False)}) + len(set(grams))


def test_long_texts_come_in_pieces(monkeypatch):
    body = ("wört " * 300).encode()
    for limit, t in ((64, body), (64, "ü".encode() * 400), (7, b"a" * 50)):
        monkeypatch.setattr(subword, "CHUNK_BYTES", limit)
        monkeypatch.setattr(subword, "chunks", lambda at, limit=limit: iter([(i, i + 1) for i in range(len(at) - 1)]))
        raw = np.frombuffer(t, np.uint8)
        parts = [own.tobytes() for _, own, _ in subword.pieces(raw, np.array([0, len(raw)]))]
        assert b"".join(parts) == t and max(map(len, parts)) <= limit and all(p.decode() for p in parts)


def bad(i: int) -> str:
    r = random.Random(i)
    return [" | ".join(text(40).split()), " ".join(w + r.choice(["***", "$$$"]) for w in text(40).split()), text(40).upper(), "again " * 60][i % 4]


def test_quality_of_held_out_rows(spark, tmp_path_factory):
    rows = [(i, bad(i) if i % 3 == 0 else text(60), None, 1, None, None) for i in range(600)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (7, 1, 1)]
    rows += [(1000, None, None, 1, None, None), (1001, "", None, 1, None, None), (None, "text", None, 1, None, None), (7, rows[7][1], None, 1, None, None)]
    found = subword.op13_subword_quality(spark, saved(spark, tmp_path_factory, rows, labels))
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    out = found.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["doc_id"] not in (1000, 1001) or r["score"] == 0.5
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held) > 90
    assert len({r["score"] for r in out if r["doc_id"] == 7}) == 1


def test_held_out_labels_do_not_matter(spark, tmp_path_factory):
    rows = [(i, bad(i) if i % 3 == 0 else text(30), None, 1, None, None) for i in range(60)]
    scores = []
    for flipped in (False, True):
        labels = [(i, int((i % 3 != 0) ^ (flipped and zlib.crc32(str(i).encode()) % 5 == 0)), 0) for i in range(60)]
        scores.append(sorted((r["doc_id"], r["score"]) for r in subword.op13_subword_quality(spark, saved(spark, tmp_path_factory, rows, labels)).collect()))
    assert scores[0] == scores[1]


def test_descent_lowers_the_loss():
    vectors, output = subword.begun(64, 4, 1)
    rows = [(i % 2, np.array([i % 2 + 2 * (i % 5), 20 + i % 7]), np.array([0.5, 0.5], np.float32)) for i in range(60)]

    def loss():
        z = np.array([output @ (s @ vectors[b]) for _, b, s in rows])
        return float(np.mean([np.log(np.exp(x - x.max()).sum()) - (x - x.max())[y] for x, (y, _, _) in zip(z, rows, strict=True)]))

    before = loss()
    for _ in range(5):
        subword.descended(vectors, output, rows, 0.5)
    assert loss() < 0.5 * before


def test_without_rows(spark, empty):
    for query in (importance.op11_crc_ring, spelling.op12_errata_trie, subword.op13_subword_quality):
        assert query(spark, empty).count() == 0


def test_without_labels(spark, folder):
    assert {r["score"] for r in subword.op13_subword_quality(spark, folder).collect()} == {0.5}


@pytest.mark.parametrize(("query", "sql"), [(importance.op11_crc_ring, importance.ORACLE), (spelling.op12_errata_trie, spelling.ORACLE)])
def test_sql(spark, query, sql):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = query(spark, folder)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_a_hot_key_is_dealt_in_blocks(spark):
    from corpusmill.llm import sharding

    rows = [(None, "the same")] * 700 + [(i, f"text {i}") for i in range(300)] + [(5, "text 5")] * 2
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=7, block=64).collect()
    assert sorted(r["row"] for r in found) == sorted(r["place"] for r in found) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len(t) + 16, zlib.crc32(t.encode())) for i, t in rows)
    assert max(Counter(r["shard"] for r in found).values()) - min(Counter(r["shard"] for r in found).values()) <= 1
    assert all((r["shard"], r["slot"]) == (r["place"] % 7, r["place"] // 7) for r in found)


def test_archives_of_large_records(spark, tmp_path, tmp_path_factory):
    from corpusmill.llm import warc

    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, f"http://a.org/{i}", str(i) * n) for i, n in enumerate([10] * 40 + [50_000] * 70 + [300_000] * 6 + [None, 0])  if n is not None] + [(900, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    pages.write.parquet(f"{folder}/pages.parquet")
    typed, classes = warc.typed(pages)
    assert [c[:2] for c in classes] == [(-1, 64 << 10), (64 << 10, 1 << 20)] and [c[2] for c in classes][1] == 64
    found = {r["page_id"]: r["payload_bytes"] for r in warc.op7_warc_history(spark, folder).collect()}
    assert found == {i: len((h or "").encode()) for i, _, h in rows}


def test_contamination_without_proximity(spark):
    from corpusmill.llm import decontaminate

    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    plain = decontaminate.contamination(docs, items, ["doc_id"], slop=None)
    whole_ = decontaminate.contamination(docs, items, ["doc_id"])
    assert plain.columns == [c for c in whole_.columns if "near" not in c]
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r)[:6] for r in whole_.collect())


BESIDE = {"email": lambda i: f"agent{i}@corp.example", "ip": lambda i: f"10.1.{i}.7", "card": lambda i: luhn_number(i), "phone": lambda i: f"+44 20 7946 {i:04d}"}


def luhn_number(i: int) -> str:
    head = f"400000000000{i:03d}"
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(head))
    return head + str(-total % 10)


def test_planted_disclosures_are_found(spark):
    """For each base kind a word that stands beside its values, for each of some recurring values a name: all are found, and nothing in clean texts."""
    from corpusmill.llm import privacy

    r = random.Random(12)
    common = [f"common{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows, planted = [], {}
    for kind, value in BESIDE.items():
        for i in range(25):
            rows.append(f"{say(20)} cue{kind} {value(i)} {say(20)}")
            planted[len(rows) - 1] = f"cue{kind}"
        for k in range(4):
            for _ in range(6):
                rows.append(f"{say(15)} name{kind}{'abcd'[k]} {value(100 + k)} {say(15)}")
                planted[len(rows) - 1] = f"name{kind}{'abcd'[k]}"
    rows += [say(40) for _ in range(2000)]
    found = {x["doc_id"]: [t["term"] for t in x["terms"]] for x in privacy.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    hit = sum(planted[i] in found[i] for i in planted)
    assert hit == len(planted), f"recall {hit / len(planted)}, without {sorted({planted[i] for i in planted if planted[i] not in found[i]})}"
    assert not any(found[i] for i in range(len(rows)) if i not in planted)
    assert all(set(found[i]) == {planted[i]} for i in planted)


def test_a_page_of_many_values(spark):
    """Pairs grow with values, not with values times words; every name is found."""
    from corpusmill.llm import privacy

    page = " ".join(f"person{i} of {'filler ' * 30} box{i}@corp.example {'filler ' * 30}" for i in range(300))
    rows = [page + f" version{k}" for k in range(5)] + [f"filler text {i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    told = privacy.Said(privacy.written(privacy.base_spans(docs), "base"))
    assert told.beside.count() <= 5 * 300 * 10
    found = {x["doc_id"]: {t["term"] for t in x["terms"]} for x in privacy.find(docs).collect()}
    assert len([t for t in found[0] if t.startswith("person")]) == 300 and not found[100]


def test_one_of_each_keeps_clashing_columns(spark):
    from corpusmill.llm import neardup

    rows = [(1, "a b c d e f g", "x", "y", "z"), (2, "a b c d e f g", "x", "y", "z"), (3, None, None, "q", None), (1, "a b c d e f g", "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _text string, _row string")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def sharing(rng: random.Random, n: int) -> list[str]:
    """Texts of one passage and words of their own, with a few near copies of every tenth."""
    fresh = lambda k: " ".join(f"w{rng.getrandbits(40):x}" for _ in range(k))
    passage, texts = fresh(130), []
    for i in range(n):
        text = f"{passage} {fresh(100)}"
        texts += [text] + [f"{text} {fresh(4)}" for _ in range(3 if i % 10 == 0 else 0)]
    return texts


def test_large_buckets_lose_no_link(spark):
    """Parted by their rarer coordinates, buckets of a shared passage give the classes of brute force."""
    import brute

    from corpusmill.llm import neardup

    texts = sharing(random.Random(5), 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["class_id"] for x in neardup.classes(docs, block=4, large=8).collect()}
    assert found == brute.classes(list(enumerate(texts))) and len(set(found.values())) == 300


def test_signatures_that_agree_share_a_rarer_coordinate(spark):
    from corpusmill.llm import neardup

    r = np.random.default_rng(3)
    base = r.integers(1, 1 << 32, 80, dtype=np.uint32)
    signed = [np.where(r.random(80) < share, base, r.integers(1, 1 << 32, 80, dtype=np.uint32)) for share in r.choice([0.3, 0.6, 0.75, 0.9], 200)]
    signs = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(signed)], "_node long, signature binary")
    tokens = neardup.rarer_tokens(signs, 48)
    own = [set() for _ in signed]
    for x in tokens.collect():
        own[x["_node"]].add(x["token"])
    assert all(len(x) <= 33 for x in own)
    agreeing = [(i, j) for i in range(200) for j in range(i) if (signed[i] == signed[j]).sum() >= 48]
    assert agreeing and all(own[i] & own[j] for i, j in agreeing)


def test_a_bucket_of_unlike_texts_is_parted(spark):
    """100,000 texts that the hub's class left, in pairs by 33 coordinates: what meets in a task is bounded, and grows with the rows, not with their square."""
    from pyspark.sql import functions as F

    from corpusmill.llm import neardup

    known = [F.col("id").alias("_node"), F.col("id").alias("component"), F.lit(9).alias("size"), F.lit(9).alias("shared")]
    placed = spark.range(100_000).select(F.lit(1).cast("long").alias("bucket"), F.lit(100_000).cast("long").alias("n"), F.lit(-1).cast("long").alias("main"), *known)
    tokens = spark.range(100_000).select(F.col("id").alias("_node"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k"))
    tokens = tokens.select("_node", F.expr("(_node div 2) * 33 + k").alias("token"))
    most, rows = neardup.met(placed, tokens, 96, neardup.LARGE).groupBy("bucket", "block").count().agg(F.max("count"), F.sum("count")).first()
    assert most == 4 and rows == 2 * 33 * 100_000
    common = spark.range(100_000).select(F.col("id").alias("_node"), F.lit(1).cast("long").alias("token"))
    few = placed.filter("_node < 9000")
    assert neardup.met(few, common, 96, 960).groupBy("bucket", "block").count().agg(F.max("count")).first()[0] < 1300
