"""Repeated rows and very long texts, in the operators whose docstrings define a result for them."""

from __future__ import annotations

import random
from collections import Counter

import brute
import pytest

from corpusmill.llm import decontaminate, language, linededup, quality

r = random.Random(29)


def words(n: int) -> str:
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ren", "ust", "ei"]) for _ in range(r.randint(1, 4))) for _ in range(n))


LINE = "one line that several documents have in common"
LONG = words(40_000)
ITEM = words(40)
ROWS = [(i, f"{words(30)}\n{LINE}\n{words(30)}\n{LINE}") for i in range(6)]
ROWS += [ROWS[2], ROWS[5], ROWS[5], (None, ROWS[1][1]), (None, ROWS[1][1]), (7, None), (7, None), (8, ""), (8, "")]
ROWS += [(9, f"{LONG}\n{LINE}\n{ITEM}"), (9, f"{LONG}\n{LINE}\n{ITEM}"), (10, f"{words(10)} {ITEM} {words(10)}")]
ROWS += [ROWS[-1]] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def test_lines_of_repeated_rows(spark, folder):
    """Each row is a document; all rows of the largest doc_id keep the line, null is never the largest."""
    found = Counter((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in linededup.op6_levelled_line_runs(spark, folder).collect())
    key = lambda line: brute.lower(line.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, list] = {}
    for i, t in ROWS:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(-1 if i is None else i)

    def plain(i, t):
        lines = (t or "").split("\n")
        own = -1 if i is None else i
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or own == max(holders[key(x)])]
        return i, len(lines), len(lines) - len(kept), brute.sha256("\n".join(kept))

    assert found == Counter(plain(i, t) for i, t in ROWS)


def test_quality_of_repeated_rows(spark, folder):
    found = quality.op8_kneser_ney_quality(spark, folder).collect()
    assert Counter(x["doc_id"] for x in found) == Counter(i for i, _ in ROWS)
    for i in {i for i, _ in ROWS}:
        assert len({tuple(x) for x in found if x["doc_id"] == i}) == 1
    bits = brute.kneser_ney([(t, "en") for _, t in ROWS])
    told = {i: b for (i, _), b in zip(ROWS, bits, strict=True)}
    for x in found:
        assert x["bits"] == (None if told[x["doc_id"]] is None else pytest.approx(told[x["doc_id"]], rel=1e-5))


def test_contamination_of_repeated_rows_and_a_long_text(spark, docs):
    items = [(1, ITEM), (1, ITEM), (2, LINE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = Counter((x["doc_id"], x["n_words"], x["n_hit"], x["contaminated"]) for x in decontaminate.contamination(docs, bench, ["doc_id"]).collect())

    def plain(i, t):
        n, hit, _ = brute.contamination(t, items)
        return i, n, hit, hit > 0 and 20 * hit >= n

    assert found == Counter(plain(i, t) for i, t in ROWS)
    assert found[(9, 40_000 + 8 + 40, 48, False)] == 2 and found[(10, 60, 40, True)] == 3


def test_language_of_repeated_rows(spark, folder):
    found = language.op10_zstd_language(spark, folder).collect()
    assert Counter(x["doc_id"] for x in found) == Counter(i for i, _ in ROWS)
    for i in {i for i, _ in ROWS}:
        assert len({(x["lang_pred"], x["score"]) for x in found if x["doc_id"] == i}) == 1
