"""Language of a text by compression: the dictionary that makes it smallest names it.

Every language gets a raw-content zstandard dictionary of sample texts. A text is cut into
pieces, so that the dictionary and not the text's own past decides; each piece is compressed
with each dictionary, and the sizes are added up over the whole text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lexloom.llm import words
from lexloom.operators.ordered import top_k
from lexloom.session import small

SAMPLE_TEXTS = 800  # labelled texts per language in its dictionary, at most
SAMPLE_BYTES = 1 << 20  # bytes of a dictionary, at most; a text that does not fit any more is left out whole
PIECE_BYTES = 2048
LEVEL = 6
MIN_MARGIN = 0.01  # best and second size closer than this share of the second: rejected
UNDETERMINED = "und"
# lower-case letters carry the language; ASCII digits and signs become blanks, runs of them shrink by compression
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def fit(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Dictionary content per language, from (text, lang).

    Learns from a bounded sample of whole texts: of each language the ``sample_texts`` distinct
    texts with the smallest hashes, and of these in that order as many as ``sample_bytes`` hold (at
    least one). Rows with null text or language teach nothing. The sample is drawn from hashes
    alone: languages are counted first, so that each hands on some four times the sample however
    large it is, and only chosen texts move.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("hash"))
    order = F.pmod("hash", F.lit(1 << 30))
    share = known.groupBy("lang").agg((F.lit(4.0 * sample_texts * (1 << 30)) / F.approx_count_distinct("hash")).alias("share"))
    low = known.select("lang", "hash").join(small(share), "lang").where(order < F.col("share")).select("lang", "hash").distinct()
    chosen = top_k(low, ["lang"], [order, F.col("hash")], sample_texts, "n")
    texts = known.join(small(chosen), ["lang", "hash"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    content: dict[str, list[bytes]] = {}
    for r in texts.orderBy("lang", "n").toLocalIterator():  # the bounded sample, a partition at a time
        held, text = content.setdefault(r["lang"], []), _plain(r["text"])
        if not held or sum(map(len, held)) + len(held) + len(text) <= sample_bytes:
            held.append(text)
    return {lang: b"\n".join(reversed(held)) for lang, held in content.items()}


def _plain(text: str) -> bytes:
    return text.lower().encode().translate(_PLAIN)


class _Sizes:
    """Compressors of all languages."""

    def __init__(self, content: dict[str, bytes]):
        self.languages = sorted(content)
        self.compressors = []
        for lang in self.languages:
            book = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False))

    def of(self, data: bytes) -> list[int]:
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return UNDETERMINED, 0.0, True
        sizes = np.array(self.of(_plain(text)), float)
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / second
        return self.languages[order[0]], float(min(1.0, 0.5 + 5 * margin)), bool(margin < MIN_MARGIN)


def predict(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document.

    Needs doc_id and text; other columns are not read. A null text, or one without a letter,
    is ``und``, score 0, rejected; so is every text when no language was learned. Equal sizes
    go to the first language by name. ``rejected`` marks narrow margins; the score is 0.5 at
    no margin and 1 from a tenth on. Repeated rows are judged one by one, an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)  # languages * SAMPLE_BYTES, or a language's only text

    def run(batches):
        sizes = _Sizes(shared.value)
        for batch in words.slices(batches):
            found = [sizes.judge(t) for t in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
