"""What later findings named: joins of large tables that must not pass through the driver."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from corpusmill.llm import common, packing, spelling


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_word_tables_are_not_broadcast(spark):
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate([("castle", 9), ("castla", 3), ("castl", 4), ("window", 5), ("windows", 4)])], "id long, word string, n long")
    found = spelling.near(common.written(words, "words"))
    assert "Broadcast" not in plan_of(found)
    assert {r["word"]: r["n_near"] for r in found.collect()} == {"castle": 2, "castla": 2, "castl": 2, "window": 1, "windows": 1}


def test_a_lookup_beyond_its_limit_is_shuffled(spark):
    known = common.written(spark.range(50).selectExpr("id", "id * 2 AS v"), "known")
    found = common.lookup(spark.range(500).selectExpr("id % 70 AS id", "id AS x"), known, ["id"], "left", limit=0)
    assert "Broadcast" not in plan_of(found)
    assert all(r["v"] == (r["id"] * 2 if r["id"] < 50 else None) for r in found.collect()) and found.count() == 500


def test_marks_are_set_off_from_words_before_they_are_encoded():
    """A word is kept once whatever marks stand beside it, and ids stay those of whole texts."""
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, count, mean = encoder.encode(pa.array(['Castle castle, (castle) castle!! "Über,über', "castle", None]))
    assert set(encoder.codes) == {w.encode() for w in ("castle", ",", "(", ")", "!!", '"', "Über", "über")}
    whole = [encoder.whole(t) for t in ('Castle castle, (castle) castle!! "Über,über', "castle", "")]
    assert ids.tolist() == np.concatenate(whole).tolist() and count.tolist() == [len(w) for w in whole] and mean[2].tolist() == [0, 0, 0]
    r = random.Random(7)
    parts = list("aZéÉßıſǅǆŉ×÷αΣς中१7'’,.(=<|>/_`~…«\u0301\u0338\u0307\u0130\u023f\u0240\u00a0\u0085\x1c\t\n  ") + ["'s", "'ll", "I\u0307", "H\u0331", "=\u0338", "castle"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(20_000)] + [a + b + c for a in parts for b in parts for c in parts]
    ids, count, _ = encoder.encode(pa.array(["no", *texts]).slice(1))
    for text, found in zip(texts, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert found.tolist() == encoder.whole(text).tolist(), repr(text)
