"""The pipeline and each of its stages against brute force, and the numbers behind two operators in plain Python."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from test_llm_operators import DOCS, changed, rows_of, saved, words

import corpus_pipeline
from corpusmill.llm import language, sharding

r = random.Random(41)
KINDS = {"aa": ["an", "the", "ing", "er"], "bb": ["ón", "que", "ado", "ez"]}


def said(lang: str, n: int) -> str:
    return " ".join("".join(r.choice(KINDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


ITEM = said("aa", 30)
LICENCE = "This line recurs in many of the documents, word by word."
LONG = said("aa", 15000)


def documents() -> list[tuple]:
    texts: list[tuple[str | None, str | None]] = [(said(lang, 80), lang) for _ in range(60) for lang in ("aa", "bb")]
    base = said("aa", 150)
    texts += [(base, "aa"), (base, "aa"), (changed(base, 151, 3), "aa"), (base.upper(), None)]
    texts += [(f"{LICENCE}\n{said('bb', 40)}\n{LICENCE.upper()} ", "bb") for _ in range(5)]
    texts += [(f"{ITEM} {said('aa', 40)}", "aa"), (said("aa", 300) + " " + ITEM, "aa")]
    texts += [(None, "aa"), ("", "aa"), ("123 !", "bb"), (LONG, "aa"), (LICENCE, "aa"), (LICENCE, "aa")]
    return [(i, t, lang, "src", None if t is None else len(t), "clash", "clash") for i, (t, lang) in enumerate(texts)]


ROWS = documents()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = saved(spark, ROWS, tmp_path_factory)
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def staged(spark, folder, rows):
    """What each stage makes of `rows`, as rows."""
    import tempfile

    docs = spark.createDataFrame(rows, DOCS)
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tempfile.mkdtemp()}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(rows_of(docs))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    return out


def test_stages(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = ROWS
    first, second, third, fourth, pieces = staged(spark, folder, rows)
    kept = {x["doc_id"] for x in first}
    gone = {i for i, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert kept.isdisjoint(gone) and len(kept) >= 0.95 * (len(rows) - len(gone))

    lines = brute.dedup_lines([(x["doc_id"], x["text"]) for x in first])
    assert {x["doc_id"]: x["text"] for x in second} == {i: text for i, (_, _, text) in lines.items()}
    assert all(x["n_chars"] == len(x["text"]) for x in second)

    classes = brute.classes([(x["doc_id"], x["text"]) for x in second])
    assert {x["doc_id"] for x in third} == {i for i, c in classes.items() if i == c} and len(third) < len(second)

    clean = set()
    for x in third:
        n, hit, _ = brute.contamination(x["text"], [(1, ITEM), (2, None)])
        clean |= set() if hit > 0 and 20 * hit >= n else {x["doc_id"]}
    assert {x["doc_id"] for x in fourth} == clean and len(fourth) < len(third)

    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = {x["doc_id"]: np.array([*tokenizer.encode(x["text"], add_special_tokens=False).ids, 1], "<u4") for x in fourth}
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    assert sorted(rows_of(corpus_pipeline.run(spark, folder)), key=repr) == sorted(pieces, key=repr)


def test_empty_and_unlabelled_documents(spark, folder):
    assert [len(x) for x in staged(spark, folder, [])] == [0] * 5
    bare = [(*x[:2], None, *x[3:]) for x in ROWS[:20]] + [(None, None, None, None, None, None, None)]
    assert len(staged(spark, folder, bare)[0]) == 20


def test_repeated_rows_stay_once(spark, folder):
    one = (7, said("aa", 60), None, "s", 1, "", "")
    none = (None, said("bb", 60), None, "s", 1, "", "")
    _, _, third, _, _ = staged(spark, folder, [one, one, none, none, (None, None, None, None, None, "", "")])
    assert sorted((x["doc_id"] is None, x["text"]) for x in third) == [(False, one[1]), (True, none[1])]


def test_language_sizes_equal_plain_compression(spark):
    """Predictions and rejections, with dictionaries and parts made by hand."""
    import zstandard

    rows = [x for x in ROWS if x[1]]
    docs = spark.createDataFrame(rows, DOCS)
    content = language.dictionaries(docs)
    train = [x for x in rows if x[2] and zlib.crc32(str(x[0]).encode()) % 3 != 1]
    assert set(content) == {x[2] for x in train}
    for lang, data in content.items():  # every piece is from a training text of that language
        assert all(any(piece in x[1].lower() for x in train if x[2] == lang) for piece in data.decode().split("\n") if piece)
    found = {x["doc_id"]: x for x in language.identify(docs, content, ["doc_id"]).collect()}
    for i, text, *_ in rows:
        data = text.lower().encode()
        if not any(c.isalpha() for c in text):
            assert found[i]["lang_pred"] == "und"
            continue
        n = max(1, -(-len(data) // language.WINDOW), min(language.PARTS, len(data) // language.LEAST_PART))
        step = -(-len(data) // n)
        sizes = {}
        for lang, raw in content.items():
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            compressor = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(compressor.compress(data[k : k + step])) for k in range(0, len(data), step))
        first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        gap = (second[1] - first[1]) / second[1]
        assert found[i]["lang_pred"] == first[0] and abs(found[i]["score"] - min(1, 0.5 + 2 * gap)) < 1e-9


def test_places_equal_the_permutation(spark, folder):
    """Every row's place, recomputed from its row number."""
    found = rows_of(sharding.op3_feistel_shards(spark, folder))
    n = len(found)
    a, b = sharding.halves(n)

    def mixed(x: int, key: int) -> int:
        x = (x * 1103515245 + key) & 0xFFFFFFFF
        x ^= x >> 16
        x = x * 1566083941 & 0xFFFFFFFF
        return x ^ x >> 15

    def place(x: int) -> int:
        while True:
            left, right = x % a, x // a
            for i, key in enumerate(sharding.round_keys(sharding.SEED)):
                if i % 2 == 0:
                    left = (left + mixed(right, key)) % a
                else:
                    right = (right + mixed(left, key)) % b
            x = right * a + left
            if x < n:
                return x

    assert all(x["place"] == place(x["row"]) for x in found)
