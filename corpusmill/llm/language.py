"""Language identification by compression.

Each language is a raw-content zstandard dictionary made of training texts. A
text, in lower case, is compressed with every dictionary and gets the language under which it
comes out smallest. Texts are compressed in parts and the parts' sizes added, so
that the whole text counts and the dictionary, not the text's own repetitions,
decides. A row is rejected where the runner-up is nearly as small (no known
language), or where the parts' own smallest sizes add up to clearly less than
the winner's (languages are mixed). A text that comes out under `SHORT` bytes
says too little for a relative gap: there a tie of the two smallest rejects.

The dictionaries are fitted on a bounded sample: of each language's training
rows, the one of the smallest hash in each of `slots` hash slots (a partial
aggregate, no ordering of the corpus), `piece` characters from each one's middle.

Defined cases: a null text or one without a letter is `und`, score 0, rejected;
rows of a null lang or doc_id are never learned from but are predicted like
others; without any training row everything is `und`; ties go to the language
that sorts first; repeated rows get equal predictions. Only doc_id, text and lang
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS, PIECE = 256, 400
WINDOW = 2048
LEVEL = 9
#: A text of two such parts or more is cut into up to PARTS of them, that a change of language shows.
LEAST_PART, PARTS = 150, 4
#: Least relative gap between the two smallest sizes of a text that is kept: of the training rows of sf0.1
#: that are told right, 0.5 % have less than 0.046.
MARGIN = 0.04
#: Most that a choice of language by part may save on the winner's size: of labelled texts of sf0.1 less than 0.5 % save more.
MIXED = 0.02
#: Compressed bytes under which one byte is a clear gap.
SHORT = 100
UNKNOWN = "und"


def held_out() -> F.Column:
    """One third of the documents, never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def dictionaries(docs: DataFrame, slots: int = SLOTS, piece: int = PIECE) -> dict[str, bytes]:
    """Raw content by language, at most slots * piece characters each."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    middle = F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int") - piece // 2)
    rows = train.select("lang", F.xxhash64("doc_id").alias("h"), F.lower("text").substr(middle, F.lit(piece)).alias("piece"))
    best = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min(F.struct("h", "piece")).alias("b"))
    found: dict[str, list[str]] = {}
    for row in best.select("lang", "slot", "b.piece").orderBy("lang", "slot").collect():  # at most slots rows a language
        found.setdefault(row["lang"], []).append(row["piece"])
    return {lang: "\n".join(x).encode() for lang, x in sorted(found.items())}


class Compressors:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL) -> None:
        import zstandard

        self.names = list(content)
        self.each = []
        for data in content.values():
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.each.append(zstandard.ZstdCompressor(level=level, dict_data=known, **options))

    def sizes(self, text: bytes, window: int = WINDOW) -> np.ndarray:
        """The size of each part (row) by language (column)."""
        parts = max(1, -(-len(text) // window), min(PARTS, len(text) // LEAST_PART))
        step = -(-len(text) // parts)
        cut = [text[i : i + step] for i in range(0, len(text), step)]
        return np.array([[len(c.compress(x)) for c in self.each] for x in cut], float)


def _predicted(batches: Iterator[pa.RecordBatch], content: dict[str, bytes], margin: float) -> Iterator[pa.RecordBatch]:
    compressors = Compressors(content)
    for batch in batches:
        lang, score, rejected = [], [], []
        for text, letters in zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True):
            if not letters or not content:
                lang.append(UNKNOWN)
                score.append(0.0)
                rejected.append(True)
                continue
            each = compressors.sizes(text.as_buffer().to_pybytes())
            size = each.sum(axis=0)
            order = np.argsort(size, kind="stable")
            first, second = size[order[0]], size[order[1]] if len(size) > 1 else np.inf
            gap = 1.0 if len(size) == 1 else (second - first) / second
            lang.append(compressors.names[order[0]])
            score.append(float(min(1.0, 0.5 + 2 * gap)))
            narrow = gap < margin if second >= SHORT else second == first
            rejected.append(bool(narrow or first - each.min(axis=1).sum() > MIXED * first))
        kept = {"_row": batch.column("_row"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
        yield pa.RecordBatch.from_pydict(kept)


def identify(docs: DataFrame, content: dict[str, bytes], keep: list[str], margin: float = MARGIN) -> DataFrame:
    """Columns `keep` of docs, lang_pred, score and rejected."""
    fields = {f.name: f for f in docs.schema.fields}
    kind = ", ".join([f"_row struct<{', '.join(f'`{c}`: {fields[c].dataType.simpleString()}' for c in keep)}>", "lang_pred string", "score double", "rejected boolean"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(lambda b: _predicted(b, content, margin), kind)
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], "lang_pred", "score", "rejected")


def op10_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, dictionaries(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
