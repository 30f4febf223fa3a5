"""Language ID by compression: the dictionary that makes a text smallest names its language.

For each language a raw-content zstandard dictionary is cut from a bounded
sample of labelled texts. A text is cut into segments (all of it, never a
prefix), each segment is compressed with every language's dictionary, and the
sizes are added up per language. Narrow margins are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import long_id, released

#: Labelled texts sampled per language at most (one of each hash slot), and their length in characters.
SAMPLE_SLOTS = 256
SAMPLE_CHARS = (100, 20_000)
#: Bytes of a dictionary, of a segment.
DICT_BYTES = 48 << 10
SEGMENT_BYTES = 2 << 10
#: Bytes of all dictionaries together (they are sent to every task); of many languages each gets a smaller one.
MODEL_BYTES = 12 << 20
#: Relative gap between the two smallest sizes under which a prediction is rejected.
MIN_MARGIN = 0.01


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict:
    """Dictionaries {lang: bytes} and counts from the labelled rows where train holds.

    The sample is bounded by SAMPLE_SLOTS texts a language: ids hash into slots,
    and the smallest hash of a slot is taken, so it does not depend on the
    layout of the table. Texts shorter or longer than SAMPLE_CHARS are sampled
    only for languages that have no others. Null or empty texts, null labels:
    left out. No labelled row: an empty model, which predicts "und".
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    n = F.length(text_col)
    odd = (n < SAMPLE_CHARS[0]) | (n > SAMPLE_CHARS[1])
    rows = docs.filter(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull() & (n > 0)).select(
        F.col(lang_col).alias("lang"), F.pmod(h, F.lit(SAMPLE_SLOTS)).alias("slot"), h.alias("h"), odd.alias("odd"), F.col(text_col).alias("text")
    )
    stats = (
        rows.groupBy("lang", "slot")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(~F.col("odd"), F.col("h"))).alias("h"),
            F.min("h").alias("any_h"),
        )
        .collect()  # SAMPLE_SLOTS rows a language at most
    )
    counts: dict[str, int] = {}
    for r in stats:
        counts[r["lang"]] = counts.get(r["lang"], 0) + r["n"]
    room = max(256, min(DICT_BYTES, MODEL_BYTES // max(1, len(counts))))
    normal = {r["lang"] for r in stats if r["h"] is not None}
    want = [(r["lang"], r["h"] if r["h"] is not None else r["any_h"]) for r in stats if r["h"] is not None or r["lang"] not in normal]
    if not want:
        return {"dicts": {}, "counts": {}}
    spark = docs.sparkSession
    picked = (
        rows.join(F.broadcast(spark.createDataFrame(want, "lang string, h long")), ["lang", "h"])
        .groupBy("lang", "h")
        .agg(F.min(F.substring("text", 1, SAMPLE_CHARS[1])).alias("text"))
        .collect()
    )
    dicts: dict[str, bytes] = {}
    for lang in sorted(counts):
        texts = [r["text"].encode() for r in sorted((r for r in picked if r["lang"] == lang), key=lambda r: r["h"])]
        share = max(256, room // max(1, len(texts)))
        left = b"\n".join(t[share:] for t in texts)[: max(0, room - sum(len(t[:share]) for t in texts))]
        dicts[lang] = (left + b"\n" + b"\n".join(t[:share] for t in texts))[-room:]
    return {"dicts": dicts, "counts": counts}


class Sizer:
    """Compressed size of a text with each dictionary."""

    def __init__(self, model: dict):
        import zstandard as z

        # ties go to the language with more labelled texts, then to the smaller name
        self.langs = sorted(model["dicts"], key=lambda x: (-model["counts"][x], x))
        self.each = []
        for lang in self.langs:
            params = z.ZstdCompressionParameters.from_level(
                3, strategy=z.STRATEGY_LAZY, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=3, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            d = z.ZstdCompressionDict(model["dicts"][lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.each.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        parts = [data[i : i + SEGMENT_BYTES] for i in range(0, len(data), SEGMENT_BYTES)]
        return [sum(map(len, map(f, parts))) for f in self.each]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, lang_pred, score, rejected) for each row; only the text is looked at.

    Null text, a text without a letter, or an empty model: "und", score 0,
    rejected. score: 1 - smallest size / size expected of the others (the mean
    of the rest), in 0..1; rejected: the gap to the second size is under min_margin of it.
    Repeated rows get a row each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MODEL_BYTES at most, or 256 bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(shared.value)
        for b in batches:
            langs, scores, rejected = [], [], []
            for text, letter in zip(b.column("text"), b.column("letter").to_pylist(), strict=True):
                if not letter or not sizer.langs:
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                s = sizer.sizes(text.as_py())
                k = min(range(len(s)), key=s.__getitem__)
                rest = s[:k] + s[k + 1 :]
                langs.append(sizer.langs[k])
                scores.append(max(0.0, min(1.0, 1 - s[k] * len(rest) / max(1, sum(rest)))) if rest else 1.0)
                rejected.append(bool(rest) and min(rest) - s[k] < min_margin * min(rest))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(
        long_id(docs, id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    return rows.mapInArrow(released(run), "id long, lang_pred string, score double, rejected boolean")
