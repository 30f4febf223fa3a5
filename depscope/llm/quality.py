"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k | x) = sigmoid(threshold_k - w.x) with one weight vector for all
grades and ordered thresholds. x holds hashed features of the whole text: the set of
its words and runs of signs, and bins of the shares of signs and capitals. The model is
fitted on a bounded sample of labelled rows (proximal gradient, L1), so most
weights are exactly zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import long_id, released

SLOTS = 1 << 17
#: Labelled rows the model is fitted on at most: those of smallest id hash.
SAMPLE_ROWS = 12_000
L1 = 4e-4
ROUNDS = 400
#: A document stays if its probability of the top grade is at least this.
MIN_TAIL = 0.5
_TOKENS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+").findall
_WORD = re.compile(r"[^\W_]")


def features(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct slots of a text; known caches the slots of tokens."""
    if not text:
        return np.zeros(0, np.int32)
    tokens = _TOKENS(text)
    found = set()
    signs = 0
    for t in tokens:
        if not _WORD.match(t):
            signs += 1
    if len(known) > 500_000:
        known.clear()
    for t in set(tokens):
        k = known.get(t)
        if k is None:
            k = known[t] = zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) % (SLOTS - 64) + 64
        found.add(k)
    upper, letters = sum(map(str.isupper, tokens)), max(1, len(tokens) - signs)
    found.add(min(20, 20 * signs // len(tokens)) if tokens else 63)
    found.add(32 + min(20, 20 * upper // letters))
    return np.array(sorted(found), np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = L1, rounds: int = ROUNDS) -> dict:
    """Weights and thresholds for rows of slots. No rows: weights zero, the top grade certain."""
    cuts = n_grades - 1
    if not len(rows):
        return {"w": np.zeros(SLOTS), "theta": np.full(cuts, -40.0)}
    col = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.array([(grades <= k).mean() for k in range(cuts)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    w = np.zeros(SLOTS)
    grow = np.full(SLOTS, 1e-4)  # squared gradients, for steps of each weight
    grow_t = np.full(cuts, 1e-4)
    n = len(rows)
    for _ in range(rounds):
        eta = np.bincount(row, w[col], n)
        up = np.append(theta, np.inf)[grades]
        lo = np.append(-np.inf, theta)[grades]
        pu, pl = np.where(np.isinf(up), 1.0, _sigmoid(up - eta)), np.where(np.isinf(lo), 0.0, _sigmoid(lo - eta))
        p = np.maximum(pu - pl, 1e-9)
        du, dl = pu * (1 - pu), pl * (1 - pl)
        g_eta = (du - dl) / p / n
        g = np.bincount(col, g_eta[row], SLOTS)
        g_t = np.array([-(du / p)[grades == k].sum() + (dl / p)[grades == k + 1].sum() for k in range(cuts)]) / n
        grow += g * g
        grow_t += g_t * g_t
        step = 0.3 / np.sqrt(grow)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = np.maximum.accumulate(theta - 0.1 * g_t / np.sqrt(grow_t))
    return {"w": w, "theta": theta}


def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> dict:
    """Model from docs whose id has a grade (0 .. n_grades - 1) in labels.

    A null id, or a null grade: left out. Of several grades of an id the lowest counts. Only
    SAMPLE_ROWS ids are used, the first by hash, so the layout of the tables does not matter.
    """
    graded = (
        labels.select(F.col(label_id).cast("long").alias("id"), grade.cast("int").alias("grade"))
        .filter("id is not null and grade is not null")
        .groupBy("id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(SAMPLE_ROWS)
    )
    rows = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(graded), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            x = [features(t.as_py(), known).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grade"), pa.array(x, pa.binary())], ["id", "grade", "x"])

    got = rows.mapInArrow(released(run), "id long, grade int, x binary").dropDuplicates(["id"]).collect()  # SAMPLE_ROWS at most
    got.sort(key=lambda r: r["id"])
    return fit_rows([np.frombuffer(bytes(r["x"]), np.int32) for r in got], np.array([r["grade"] for r in got], np.int64), n_grades)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, expected_grade, tail) and the columns keep of each row; tail is the probability of the top grade.

    A null or empty text has no feature: it gets the thresholds' own probabilities. Repeated rows get a
    row each; an empty table gives an empty result. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, theta = shared.value["w"], shared.value["theta"]
        known: dict[str, int] = {}
        for b in batches:
            eta = np.array([w[features(t.as_py(), known)].sum() for t in b.column("__text")], float)
            above = 1 - _sigmoid(theta[None, :] - eta[:, None])  # P(grade > k)
            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), *[b.column(f"__c{k}") for k in range(len(keep))], pa.array(above.sum(axis=1)), pa.array(above[:, -1])],
                ["id", *[f"__c{k}" for k in range(len(keep))], "expected_grade", "tail"],
            )

    rows = docs.select(long_id(docs, id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__c{k}") for k, c in enumerate(keep)])
    kinds = [f"__c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)]
    return rows.mapInArrow(released(run), ", ".join(["id long", *kinds, "expected_grade double", "tail double"]))


def label_grade() -> Column:
    """0 toxic, 1 of low quality, 2 good; null where neither label says."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def select_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of docs whose tail is at least min_tail, with all their columns."""
    model = fit(docs, labels, label_grade(), 3, id_col, text_col)
    kept = predict(docs, model, id_col, text_col, tuple(docs.columns)).filter(F.col("tail") >= min_tail)
    return kept.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)])
