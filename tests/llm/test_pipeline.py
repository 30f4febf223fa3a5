"""Each stage of the pipeline on the rows that its predecessor kept, against plain computations."""

import re
import zlib
from collections import Counter

import numpy as np

from depscope.llm import quality
from depscope.llm.queries import tokenizer_file
from test_operators import SF, weighted_bags, weighted_jaccard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def kept_by_quality(spark, rows):
    """Everything whose probability of the top grade, by the fitted weights, is a half or more."""
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), quality.label_grade(), 3)
    tail = lambda t: 1 - 1 / (1 + np.exp(-(model["theta"][-1] - sum(model["w"][k] for k in quality.features(t, {})))))
    return [r for r in rows if tail(r["text"]) >= 0.5]


def kept_by_exact(spark, rows):
    least = {}
    for r in rows:
        least[lower(r["text"])] = min(r["doc_id"], least.get(lower(r["text"]), r["doc_id"]))
    return [r for r in rows if least[lower(r["text"])] == r["doc_id"]]


def kept_by_near(spark, rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    bags = weighted_bags([r["text"] for r in rows])
    top = list(range(len(rows)))
    for k in range(len(rows)):
        for j in range(k):
            if bags[k] == bags[j] == {} or bags[k] and bags[j] and weighted_jaccard(bags[k], bags[j]) >= 0.8:
                old, new = max(top[k], top[j]), min(top[k], top[j])
                top = [new if t == old else t for t in top]
    return [r for k, r in enumerate(rows) if top[k] == k]


def kept_by_decontamination(spark, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(b["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return [r for r in rows if not hit(words(r["text"]))]


def test_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    checks = dict(zip(["quality", "exact", "near", "decontaminate"], (kept_by_quality, kept_by_exact, kept_by_near, kept_by_decontamination), strict=True))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name in checks:
            assert docs.columns == COLUMNS
            assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, checks[name](spark, rows))), name
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] >= sizes[4] > 0
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), Counter()
    for r in rows:
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], p, len(c), zlib.crc32(c.tobytes())) for p, c in enumerate(np.split(ids, range(2048, len(ids), 2048))))
    packed = docs.collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert max(Counter({s: sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}}).values()) <= 2048


def test_awkward_rows_and_an_empty_table(spark):
    import corpus_pipeline

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(-1, None, None, None, None), (None, "a null id", "en", "s", 9), (-2, "", None, "s", 0), (-3, "twice", None, "s", 5), (-3, "twice", None, "s", 5)]
    odd = spark.createDataFrame(rows, whole.schema)
    distinct = [rows[1], rows[2], rows[3]]  # of null and empty the smaller id, of repeated rows one
    want = {"quality": rows, "exact": distinct, "near": distinct, "decontaminate": rows}  # without labels quality keeps all
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name == "pack":
            assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"]) for r in out.collect()) == [("-1", 0, 0, 1), ("-2", 0, 0, 1), ("-3", 0, 0, 2), ("-3", 0, 0, 2), ("None", 0, 0, 4)]
        else:
            assert out.columns == COLUMNS and Counter(map(tuple, out.collect())) == Counter(want[name]), name
        assert stage(spark, odd.limit(0), SF).count() == 0
