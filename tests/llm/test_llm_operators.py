"""Each operator against a brute-force version, over cases that data may bring."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from corpusmill.llm import chat, decontaminate, language, linededup, neardup, packing, privacy, quality, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _id string"
rng = random.Random(7)
SYLLABLES = ["an", "the", "ing", "er", "on", "st", "re", "ed", "ou", "ha"]


def words(n: int, r: random.Random = rng) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


LINE = "A Line that many Documents share, in some case."
BASE = words(200)


def changed(text: str, every: int, offset: int) -> str:
    return " ".join("changed" + str(offset) if i % every == offset % every else w for i, w in enumerate(text.split(" ")))


TEXTS = [
    None,
    None,
    "",
    "",
    " \n\t\n",
    "one",
    "One",
    "one two three four",
    "4111 1111 1111 1111 and a@b.co, +49 (30) 1234567 or 10.0.0.255",
    BASE,
    BASE,
    BASE.upper(),
    changed(BASE, 67, 3),
    changed(BASE, 67, 20),
    changed(BASE, 67, 40),
    changed(BASE, 9, 2),
    f"{LINE}\nrest\n{LINE}",
    f"  {LINE.lower()}  \nother\nother",
    f"{LINE}\n\n",
    "<|endoftext|> <|EndOfText|> x<|im_start|>",
    "é ü ñ Ça İstanbul naïve. no-break space   x\x1fy \U0001f600",
    "word. word, Word... it's don't *** . , 12,3 a.b",
    words(3000),
    ("long " * 30000) + "end",
    "x" * 50000,
]
ROWS = [(i, t, None if i % 5 == 0 else "en", "src0", None if t is None else len(t), "clash", "clash") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return saved(spark, ROWS, tmp_path_factory)


def saved(spark, rows, tmp_path_factory, name="documents", kind=DOCS):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = saved(spark, [], tmp_path_factory)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_empty_tables(spark, empty):
    for query in (
        chat.op1_perspective_rotation,
        neardup.op2_dart_minhash,
        sharding.op3_feistel_shards,
        packing.op4_hilbert_packing,
        privacy.op5_disclosure,
        linededup.op6_levelled_line_runs,
        warc.op7_warc_history,
        quality.op8_kneser_ney_quality,
        decontaminate.op9_positional_index,
        language.op10_zstd_language,
    ):
        assert query(spark, empty).count() == 0


def test_chat_perspectives(spark, tmp_path_factory):
    turns = [(1, 0, "system", "be <|end|> kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é\n"), (2, 0, "system", "alone"), (3, None, None, "x"), (3, 40, "ann", "late"), (None, 0, "ann", "y"), (1, 3, "ann", "é\n")]
    folder = saved(spark, turns, tmp_path_factory, "conversations", "conv_id long, turn long, role string, text string")
    found = rows_of(chat.op1_perspective_rotation(spark, folder))
    one = next(r for r in found if r["conv_id"] == 1 and r["perspective"] == "ann")
    assert one["rendered"] == "<|system|>\nbe < |end|> kind\n<|end|>\n<|assistant|>\nhi\n<|end|>\n<|user name=bob|>\n\n<|end|>\n" + "<|assistant|>\né\n\n<|end|>\n" * 2
    assert [one["rendered"][int(a) : int(b)] for a, b in (s.split(":") for s in one["mask"].split(","))] == ["hi", "é\n", "é\n"]
    assert (one["n_turns"], one["n_trained"]) == (5, 3)
    assert {(r["conv_id"], r["perspective"], r["block"]) for r in found} == {(1, "ann", 0), (1, "bob", 0), (3, "unknown", 0), (3, "ann", 0), (None, "ann", 0)}


def test_chat_of_hot_long_and_forged_conversations(spark, tmp_path_factory):
    """Roles that hold markers, a conversation of null keys and repeated rows, a very long turn, extra columns: against plain Python."""
    r = random.Random(13)
    roles = ["bob<|end", "ann\n<|assistant", "|>\n<|end|>", "cy\u2028\x00x", None, "system", "dan"]
    turns = [(None, None, r.choice(roles), r.choice(["same", "<|end|>", None, ""]), 0, "s") for _ in range(300)]
    turns += [(7, i, r.choice(roles[:3]), words(r.randint(0, 9), r), 1, "s") for i in range(100)]
    turns += [(8, 0, "dan", "y" * 300_000, 1, "s"), (8, 0, "dan", "z", 1, "s")]
    folder = saved(spark, turns, tmp_path_factory, "conversations", "conv_id long, turn long, role string, text string, block long, part string")
    found = rows_of(chat.op1_perspective_rotation(spark, folder))
    told = brute.rotations([t[:4] for t in turns])
    assert {(x["conv_id"], x["perspective"]) for x in found} == set(told)
    for key, (whole, masks) in told.items():
        own = sorted((x for x in found if (x["conv_id"], x["perspective"]) == key), key=lambda x: x["block"])
        assert [x["block"] for x in own] == list(range(own[0]["n_blocks"])) and all(x["n_turns"] <= 32 for x in own)
        assert "".join(x["rendered"] for x in own) == whole
        assert all(whole.startswith(x["rendered"], x["block_start"]) for x in own)
        assert [(x["block_start"] + int(a), x["block_start"] + int(b)) for x in own if x["mask"] for a, b in (s.split(":") for s in x["mask"].split(","))] == masks
        assert whole.count("<|assistant|>") == len(masks) and whole.count("<|end|>") == whole.count("<|") - whole.count("\n<|end|>\n") == len([t for t in turns if t[0] == key[0]])


def test_near_duplicates(spark, docs):
    found = {r["doc_id"]: r["class_id"] for r in rows_of(neardup.op2_dart_minhash(spark, docs))}
    assert found == brute.classes([(r[0], r[1]) for r in ROWS])


def test_near_duplicates_of_a_large_group(spark, tmp_path_factory):
    """More near copies than a block, a chain that leaves the hub, and texts beyond both."""
    r = random.Random(3)
    base = words(120, r)
    texts = [changed(base, 121, i % 120) + f" tail{i}" for i in range(260)] + [words(120, r) for _ in range(60)]
    chain = base.split(" ")
    for i in range(8):
        chain = chain[4:] + words(4, r).split(" ")
        texts.append(" ".join(chain))
    texts.append(" ".join(chain[:60]) + " " + words(60, r))
    rows = [(i, t, "en", "s", 1, "", "") for i, t in enumerate(texts)]
    found = {x["doc_id"]: x["class_id"] for x in rows_of(neardup.op2_dart_minhash(spark, saved(spark, rows, tmp_path_factory)))}
    assert found == brute.classes([(i, t) for i, t in enumerate(texts)])


def test_near_duplicates_that_repeat_themselves(spark, tmp_path_factory):
    """The same set of shingles said once, twice or thrice, whole or in part, is one class."""
    r = random.Random(23)
    texts = []
    for _ in range(8):
        body = words(200, r)
        chorus = " ".join(body.split(" ")[60:160])
        texts += [body, f"{body} {body}", f"{body} {body} {body}", f"{body} {chorus} {chorus} {chorus}"]
    found = {x["doc_id"]: x["class_id"] for x in rows_of(neardup.op2_dart_minhash(spark, saved(spark, [(i, t, "en", "s", 1, "", "") for i, t in enumerate(texts)], tmp_path_factory)))}
    assert found == brute.classes(list(enumerate(texts))) == {i: i - i % 4 for i in range(len(texts))}


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(5)
    k = 400
    element = r.integers(0, 2**63, 900).astype(np.uint64)
    a, b = r.integers(1, 6, 900).astype(float), r.integers(1, 6, 900).astype(float)
    b[:300] = a[:300]
    row = np.repeat([0, 1], 900)
    signed = neardup.signatures(row, np.tile(element, 2), np.concatenate([a, b]), 2, k)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signed[0] == signed[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5
    few = neardup.signatures(np.array([0, 1, 1]), element[[0, 0, 1]], np.ones(3), 3, k)
    assert few[0].all() and not few[2].any() and 0.35 < (few[0] == few[1]).mean() < 0.65


def test_shards(spark, docs):
    found = rows_of(sharding.op3_feistel_shards(spark, docs))
    texts = {r[0]: r[1] for r in ROWS}
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    assert sorted(r["place"] for r in found) == list(range(len(ROWS)))
    assert all((r["shard"], r["slot"]) == (r["place"] % 40, r["place"] // 40) for r in found)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 1001])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    walks = sharding.walk_length(spark, n)
    found = spark.range(n).select(sharding.permuted(F.col("id"), n, walks).alias("p")).collect()
    assert sorted(r["p"] for r in found) == list(range(n))


def test_shards_of_repeated_rows(spark, tmp_path_factory):
    rows = [(None if i % 2 else 4, "same", None, None, None, "", "") for i in range(90)]
    found = rows_of(sharding.op3_feistel_shards(spark, saved(spark, rows, tmp_path_factory)))
    assert sorted(r["place"] for r in found) == list(range(90))


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = rows_of(packing.op4_hilbert_packing(spark, docs))
    ids = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in ROWS}
    seen: dict[int, int] = {}
    for p in sorted(found, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == seen.get(p["doc_id"], 0) and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        seen[p["doc_id"]] = p["start"] + p["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    at = 0
    for p in sorted(found, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * 2048 + p["offset"] == at and p["offset"] + p["length"] <= 2048
        at += p["length"]


def test_packing_over_many_ranges(spark, tmp_path_factory):
    """Ranges far smaller than the corpus, a third of all rows equal: one gapless stream in order of the curve."""
    import public_tokenizers

    r = random.Random(6)
    rows = [(None, "same text", None) for _ in range(60)] + [(i, words(r.randint(0, 300), r), None) for i in range(120)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, n string")
    found = rows_of(packing.pack(docs_, public_tokenizers.path("word_bpe_49k.json"), 100, 2000))
    stream = sorted(found, key=lambda p: (p["sequence_id"], p["offset"]))
    at = 0
    for p in stream:
        assert p["sequence_id"] * 100 + p["offset"] == at
        at += p["length"]
    curves = [p["curve"] for p in stream]
    assert curves == sorted(curves) and len([p for p in found if p["doc_id"] is None and p["start"] == 0]) == 60


def test_hilbert_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(points, 3)
    assert sorted(key) == list(range(512))
    step = np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1)
    assert (step == 1).all()


def test_private_spans(spark, docs, tmp_path_factory):
    r = random.Random(5)
    texts = ["".join(r.choice("aB1.@-_%+ 0()9é4:5") for _ in range(r.randint(0, 80))) for _ in range(500)]
    texts += ["".join(r.choice("12.@- +(") for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts += ["1 " * 5000 + "@" + ".a" * 5000, "a" * 100000 + "@", "7" * 30000, "12@a.bc"]
    rows = [(i, t, None, None, None, "", "") for i, t in enumerate(texts)]
    for folder, own in ((docs, ROWS), (saved(spark, rows, tmp_path_factory), rows)):
        found = {x["doc_id"]: x for x in rows_of(privacy.op5_disclosure(spark, folder))}
        for i, text, *_ in own:
            spans = brute.private(text)
            assert found[i]["base_sha256"] == brute.sha256(",".join(spans)), text
            assert [found[i][f"n_{k}"] for k in privacy.KINDS] == [sum(s.startswith(k) for s in spans) for k in privacy.KINDS]


def test_disclosing_terms(spark):
    """A name that stands only in texts with one address gives it away, wherever it stands; common words don't."""
    texts = [f"Zanzibert was here. {'please ' * 30} write to him at zan@corp.example about matter{i} soon" for i in range(6)]
    texts += [f"please think about matter{i} and write at home to him soon, who was here" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in privacy.find(df).collect()}
    assert [texts[0][t["start"] : t["end"]] for t in found[0]["terms"]] == ["Zanzibert"]
    assert not found[10]["terms"]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert clean[0] == texts[0].replace("Zanzibert", "").replace("zan@corp.example", "<email>") and clean[10] == texts[10]


def test_disclosing_terms_equal_brute_force(spark, tmp_path_factory):
    """Words beside kinds of values, recurring values, copies that are no evidence, words that are generalised, overlaps."""
    r = random.Random(31)
    texts: list[str | None] = [None, "", "Ünïque 42"]
    for i in range(40):
        texts.append(f"{words(8, r)} Token = \"{r.getrandbits(160):040x}\" {words(5, r)}")
        texts.append(f"{words(8, r)} dial phone{i % 3} +1 ({i:03d}) 555-{i:04d} {words(5, r)}")
    texts += [f"copied rare words beside 4111 1111 1111 1111 {words(2, random.Random(1))}"] * 8
    texts += [f"the Zanzibert desk{i % 2} zan@corp.example, bob@corp.example {words(4, r)}" for i in range(7)]
    texts += [f"dial {words(6, r)} desk1 Zanzibert's" if i < 4 else words(20, r) for i in range(300)]
    texts += ["a" * 20 + "+12345678901234567890123456789012345@x.yz and 12.12.12.12.12", "secret " * 4000 + "x1" * 5000]
    rows = [(i, t, None, None, None, "", "") for i, t in enumerate(texts)]
    told = brute.disclosing(list(enumerate(texts)))
    found = {x["doc_id"]: x for x in rows_of(privacy.op5_disclosure(spark, saved(spark, rows, tmp_path_factory)))}
    for i, text in enumerate(texts):
        assert [s for s in found[i]["spans"].split(",") if s] == brute.private(text) + told[i]
        assert found[i]["n_removed"] + found[i]["n_generalised"] == found[i]["n_terms"] == sum(not s.startswith("secret") for s in told[i])
    assert any(x["n_generalised"] for x in found.values()) and any(x["n_removed"] for x in found.values())


def test_disclosing_terms_of_the_tables(spark):
    """The word that stands before keys is found in the given documents."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {x["doc_id"]: x for x in privacy.op5_disclosure(spark, "/root/testdata/sf0.01").collect()}
    told = brute.disclosing([(x["doc_id"], x["text"]) for x in docs_.collect()])
    assert sum(x["n_terms"] for x in found.values()) > 0
    assert all(found[i]["spans"].endswith(",".join(own)) for i, own in told.items())


def test_lines(spark, docs):
    found = {r["doc_id"]: r for r in rows_of(linededup.op6_levelled_line_runs(spark, docs))}
    for i, (n, dropped, text) in brute.dedup_lines([(r[0], r[1]) for r in ROWS]).items():
        assert (found[i]["n_lines"], found[i]["n_dropped"], found[i]["kept_sha256"]) == (n, dropped, brute.sha256(text))


def test_line_runs_level_up(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.ingest(spark.createDataFrame([(k, k, b) for k in range(b, b + 3)], "h1 long, h2 long, holder long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["n"], r["holder"]) for r in runs.current().collect()} == {(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 3, 3), (4, 3, 4), (5, 2, 4), (6, 1, 4)}
    probe = spark.createDataFrame([(6, 6), (7, 7)], "h1 long, h2 long")
    assert [r["h1"] for r in runs.unseen(probe).collect()] == [7]
    runs.close()
    assert not spark.sql("SHOW TABLES LIKE 'line_run*'").collect()


def test_lookup_deals_hot_keys(spark):
    """The salted join gives what the broadcast one gives."""
    from corpusmill.llm.common import lookup

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    known = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k long, w string")
    for how in ("inner", "left"):
        assert sorted(lookup(rows, known, ["k"], how, limit=-1).collect(), key=repr) == sorted(lookup(rows, known, ["k"], how).collect(), key=repr)


def test_warc(spark, tmp_path_factory):
    pages = [(1, "http://www.A.example/x?q=1", "<p>WARC/1.0\r\n\r\n</p>"), (5, "http://a.example/x?q=1", None), (7, None, ""), (3, "http://b.example", "é"), (9, "http://a.example/\r\nX: y", "é"), (4, "http://[bad", "é"), (None, "u", "n"), (9, "http://c", "é")]
    folder = saved(spark, pages, tmp_path_factory, "pages", "page_id long, url string, html string")
    found = rows_of(warc.op7_warc_history(spark, folder))
    by_page = {r["page_id"]: r for r in found}
    for page, _, html in pages:
        data = (html or "").encode()
        r = by_page[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {k: r["refers_to"] for k, r in by_page.items() if r["record_type"] == "revisit"} == {5: 7, 3: 9, 4: 9}
    order = [(r["url_key"], r["captured"], r["page_id"] if r["page_id"] is not None else -1) for r in found]
    assert order == sorted(order) and len(found) == len(pages)


def test_warc_times_are_utc(spark, tmp_path_factory):
    """Across a change of clocks in another time zone, at the ends of long, and with a very long payload and clashing columns."""
    import datetime

    big = 2**63 - 1
    at = 1710054000 - warc.EPOCH  # New York's clocks go forward
    pages = [(i, "http://a.example/", f"{i}", "x", 0) for i in (0, 1, at - 1, at, at + 3600, big, -big)] + [(5, "http://b.example", "z" * 3_000_000, "x", 0)]
    folder = saved(spark, pages, tmp_path_factory, "pages", "page_id long, url string, html string, digest string, bytes long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = {x["page_id"]: x for x in rows_of(warc.op7_warc_history(spark, folder))}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for i in (0, 1, at - 1, at, at + 3600):
        assert found[i]["captured"] == datetime.datetime.fromtimestamp(warc.EPOCH + i, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert (found[big]["captured"], found[-big]["captured"]) == ("9999-12-31T23:59:59Z", "0001-01-01T00:00:00Z")
    assert found[5]["payload_bytes"] == 3_000_000


def test_warc_runs_merge_across_archives(spark, tmp_path):
    """Small archives and ranges: the history is in one order, and an offset finds its record."""
    import gzip
    import io

    r = random.Random(2)
    pages = spark.createDataFrame([(i, f"http://h{r.randint(0, 5)}.example/{r.randint(0, 3)}", f"body {i}") for i in range(200)], "page_id long, url string, html string")
    rows, _ = warc.typed(pages)
    warc.write_archives(rows, str(tmp_path / "w"), 17)
    runs = warc.written(warc.read_archives(spark, str(tmp_path / "w")), "runs")
    found = rows_of(warc.merge_runs(runs, 20))
    key = lambda x: (x["url_key"], x["captured"], x["page_id"])
    assert [key(x) for x in found] == sorted(map(key, found)) and len({x["archive"] for x in found}) >= 12
    for x in found[::20]:
        data = gzip.decompress((tmp_path / "w" / x["archive"]).read_bytes())
        _, headers, body = next(warc.records(io.BytesIO(data[x["offset"] :])))
        assert body.decode() == f"body {x['page_id']}" and headers["WARC-Date"] == x["captured"]


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 8])
def test_loser_tree(runs):
    r = random.Random(runs)
    row = lambda: (str(r.randint(0, 9)), str(r.randint(0, 9)), r.choice([None, r.randint(0, 99)]), 0, "", "", None, str(r.randint(0, 3)), r.randint(0, 9))
    lists = [sorted((row() for _ in range(r.randint(0, 20))), key=warc.rank) for _ in range(runs)]
    assert list(map(warc.rank, warc.LoserTree(lists))) == sorted(warc.rank(x) for own in lists for x in own)


def test_quality_counts(spark, docs):
    found = {r["doc_id"]: r for r in rows_of(quality.op8_kneser_ney_quality(spark, docs))}
    for i, text, *_ in ROWS:
        counts = brute.text_counts(text)
        assert tuple(found[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert found[i]["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (found[i]["base_failed"] and found[i]["kept"])


def test_perplexity_bands(spark):
    r = random.Random(11)
    texts = [words(150, r) for _ in range(120)]
    odd = " ".join("".join(r.choice("qxzjkvw#7") for _ in range(6)) for _ in range(150))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, odd])], "doc_id long, text string, lang string")
    found = {x["doc_id"]: x["kept"] for x in quality.assess(df).collect()}
    assert [i for i, kept in found.items() if not kept] == [len(texts)]


def test_perplexity_bands_reject_spam_and_menus(spark):
    """Most symbol spam and most menus among the documents labelled bad go at the default width; the good ones stay."""
    folder = "/root/testdata/sf0.01"
    docs_ = spark.read.parquet(f"{folder}/documents.parquet")
    found = quality.assess(docs_).filter("not base_failed").select("doc_id", "kept").join(docs_.select("doc_id", "text"), "doc_id")
    found = [(x["quality"], x["text"], x["kept"]) for x in found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()]
    kinds = {"spam": lambda q, t: q == 0 and "&&&" in t, "menu": lambda q, t: q == 0 and " | " in t, "good": lambda q, t: q == 1}
    kept = {kind: [k for q, t, k in found if of(q, t)] for kind, of in kinds.items()}
    assert len(kept["spam"]) > 5 and len(kept["menu"]) > 5
    share = {kind: sum(own) / len(own) for kind, own in kept.items()}
    assert share["spam"] < 0.5 and share["menu"] < 0.5 and share["good"] > 0.97


def test_kneser_ney_equals_the_recursion(spark):
    """Bits of every text, by sorted arrays and by joins, against plain Python; surrogate pairs, short texts, null languages."""
    r = random.Random(2)
    texts = [(words(r.randint(1, 60), r), r.choice(["en", "de", None])) for _ in range(80)]
    texts += [("привет мир " * 3, "ru"), ("\U0001f600\U0001f601 ok \U0001f600", "en"), ("abc", "en"), ("ABCD 12\t99", "de"), ("", None), (None, "en"), *[(words(9, r), "en")] * 3]
    df = spark.createDataFrame([(i, t, lang, "clash") for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, code string")
    told = brute.kneser_ney(texts)
    for limit in (quality.MODEL_BYTES, 0):
        found = {x["doc_id"]: x["bits"] for x in quality.assess(df, model_bytes=limit).collect()}
        for i, bits in enumerate(told):
            assert (found[i] is None and bits is None) or abs(found[i] - bits) < 1e-4


def test_garbled_text_goes_in_every_script(spark):
    """Shuffled letters are rejected and real words stay, whatever the alphabet."""
    r = random.Random(12)
    scripts = {"ru": "абвгдежзиклмнопрст", "he": "אבגדהוזחטיכלמנסעפ", "el": "αβγδεζηθικλμνξοπρ", "zh": "的一是不了人我在有他这中大来上国"}
    rows, garbled = [], set()
    for lang, letters in scripts.items():
        known = ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(120)]
        for _ in range(120):
            rows.append((len(rows), " ".join(r.choice(known) for _ in range(120)), lang))
        garbled.add(len(rows))
        rows.append((len(rows), " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(120)), lang))
    found = {x["doc_id"]: x["kept"] for x in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(found[i] for i in garbled) and sum(not found[i] for i in found if i not in garbled) <= 0.02 * len(rows)


@pytest.mark.parametrize("shared", [1, decontaminate.SHARED])
def test_contamination(spark, tmp_path_factory, shared):
    """Exact windows and proximity, with the windows of a rarest term that many share looked up one by one or by place."""
    r = random.Random(9)
    items = [(0, words(30, r)), (1, words(5, r)), (2, "..."), (3, None), (4, words(30, r)), (14, "Ünïque TERM"), (None, words(20, r)), (6, "the an the an " * 8)]
    items.append((5, items[0][1]))
    moved = items[4][1].split()
    texts = [None, "", "...", items[0][1], "pre " + items[0][1].upper() + " post", words(50, r) + " " + items[1][1], " ".join(moved[3:16]), " ".join(moved[3:15]), "an ünïque term " + words(40, r), "Ünïque TERM", words(400, r), items[6][1] + " " + items[4][1] + " " + items[4][1]]
    texts += [" ".join([*moved[:9], "put", "in", *moved[9:20], "more", *moved[20:]]), " ".join(reversed(moved)), "term ünïque", "the an " * 300]
    rows = [(i, t, None, None, None, "", "") for i, t in enumerate(texts)] + [(None, items[0][1], None, None, None, "", "")]
    folder = saved(spark, rows, tmp_path_factory)
    spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, term string, window int").write.parquet(f"{folder}/benchmark.parquet")
    docs_, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = rows_of(decontaminate.contamination(docs_, bench, ["doc_id"], shared=shared))
    named = [("null" if i is None else i, t) for i, t in items]
    near = brute.proximity([(x[0], x[1]) for x in rows], named)
    assert len(found) == len(rows) and any(n > 0 for n, _ in near.values())
    for f in found:
        text = next(t for i, t, *_ in rows if i == f["doc_id"])
        n, hit, own = brute.contamination(text, named)
        assert (f["n_words"], f["n_hit"], f["items"]) == (n, hit, own)
        assert f["contaminated"] == (hit > 0 and 20 * hit >= n)
        assert (f["n_near"], f["near_items"]) == near[f["doc_id"]]


def test_proximity(spark):
    body = words(13, random.Random(1)).split(" ")
    body[3], body[8] = "rarest", "seldom"
    moved = [*body[:6], "inserted", "twice", *body[6:]]
    docs_ = spark.createDataFrame([(1, " ".join(body)), (2, " ".join(moved)), (3, "rarest " + "x " * 40 + "seldom")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(body))], "item_id long, text string")
    index = decontaminate.Index(docs_, items)
    assert {r["_id"] for r in index.proximity(slop=3).collect()} == {1, 2}
    assert {r["_id"] for r in index.occurrences().collect()} == {1}


def test_language(spark, tmp_path_factory):
    r = random.Random(4)
    kinds = {"aa": ["an", "the", "ing", "er"], "bb": ["ón", "que", "ado", "ez"], "cc": ["ung", "sch", "keit", "lich"]}

    def text(lang: str, n: int) -> str:
        return " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang, 60), lang, None, None, "", "") for i in range(400) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(1000, None, "aa", None, None, "", ""), (1001, "123 !", "bb", None, None, "", ""), (None, text("bb", 60), None, None, None, "", ""), (1002, text("cc", 20000), None, None, None, "", "")]
    found = {x["doc_id"]: x for x in rows_of(language.op10_zstd_language(spark, saved(spark, rows, tmp_path_factory)))}
    held = [x for x in rows if x[0] is not None and x[0] < 1000 and zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert all(found[x[0]]["held_out"] for x in held) and len(held) > 100
    assert sum(found[x[0]]["lang_pred"] == x[2] for x in held) >= 0.98 * len(held)
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and found[1000]["rejected"]
    assert found[None]["lang_pred"] == "bb" and found[1002]["lang_pred"] == "cc"
    assert all(0 <= x["score"] <= 1 for x in found.values())


def test_language_held_out_accuracy(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.identify(docs_, language.dictionaries(docs_), ["doc_id", "lang"]).filter(language.held_out())
    right = held.selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert right > 0.97


def test_language_rejects_mixed_and_unknown(spark):
    """Half-and-half texts and random letters are rejected, clean texts are kept, short ones too."""
    r = random.Random(17)
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prose = {lang: [x["text"] for x in docs_.filter(f"lang = '{lang}' and length(text) > 1500").orderBy("doc_id").limit(20).collect()] for lang in ("en", "de")}
    mixed = [f"{a[:n]} {b[:n]}" for a, b in zip(prose["en"], prose["de"], strict=True) for n in (200, 500, 1500)]
    unknown = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (40, 100, 400) for _ in range(20)]
    clean = [x[:n] for own in prose.values() for x in own for n in (80, 500, 1500)]
    kinds = [("mixed", mixed), ("unknown", unknown), ("clean", clean)]
    texts = spark.createDataFrame([(kind, t) for kind, own in kinds for t in own], "kind string, text string")
    found = language.identify(texts, language.dictionaries(docs_), ["kind"]).groupBy("kind").agg({"rejected": "count_if", "*": "count"}).collect()
    share = {x["kind"]: x["count_if(rejected)"] / x["count(1)"] for x in found}
    assert share["mixed"] > 0.9 and share["unknown"] > 0.9 and share["clean"] < 0.1
