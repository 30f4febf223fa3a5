"""The trained operators against plain computations."""

import numpy as np
import zstandard
from pyspark.sql import functions as F

from depscope.llm import langid, quality

LANGS = {"aa": "der und nicht eine über", "bb": "the and of with house", "cc": "que los para una niño"}


def rows_of_languages(n=40):
    r = np.random.default_rng(4)
    rows = []
    for k in range(n):
        lang = list(LANGS)[k % 3]
        rows.append((k, " ".join(r.choice(LANGS[lang].split(), int(r.integers(1, 600)))), lang))
    return [*rows, (100, None, "aa"), (101, "", None), (102, "12 + 7", None), (103, "the house", None), (103, "the house", None), (None, "der und", None)]


def test_language_is_the_smallest_size(spark):
    rows = rows_of_languages()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit("x"))
    model = langid.fit(docs, F.col("doc_id") < 20)
    assert set(model["dicts"]) == set(LANGS)
    train = " ".join(t for i, t, _ in rows if i is not None and i < 20 and t)
    assert all(w in train for d in model["dicts"].values() for w in d.decode(errors="ignore").split()[1:-1])
    size = {}
    for lang, d in model["dicts"].items():
        params = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        for _, t, _ in rows:
            data = (t or "").encode()
            size[lang, t] = sum(len(c.compress(data[a : a + 2048])) for a in range(0, len(data), 2048))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    text = {}
    for i, t, _ in rows:
        text[i] = t
    for r in got:
        t = text[r["id"]]
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        sizes = sorted(size[lang, t] for lang in LANGS)
        assert size[r["lang_pred"], t] == sizes[0] and 0 <= r["score"] <= 1
        assert r["rejected"] == (sizes[1] - sizes[0] < langid.MIN_MARGIN * sizes[1])
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def log_likelihood(w, theta, x, grades):
    eta = x @ w
    at = lambda k: 1 / (1 + np.exp(-(theta[k] - eta))) if 0 <= k < len(theta) else np.full(len(eta), float(k >= 0))
    p = np.select([grades == g for g in range(len(theta) + 1)], [at(g) - at(g - 1) for g in range(len(theta) + 1)])
    return np.log(p).mean()


def test_fit_is_where_the_likelihood_is_flat():
    r = np.random.default_rng(2)
    n, d = 600, 6
    x = (r.random((n, d)) < 0.4).astype(float)
    eta = x @ np.array([1.5, -1.0, 0.5, 0, 0, -2.0]) + r.logistic(size=n)
    grades = np.digitize(eta, [-1.0, 0.7])
    slots = [np.flatnonzero(v).astype(np.int32) for v in x]
    model = quality.fit_rows(slots, grades, 3, l1=0.0, rounds=3000)
    w, theta = model["w"][:d], model["theta"]
    assert theta[0] < theta[1]
    base, e = log_likelihood(w, theta, x, grades), 1e-5
    for k in range(d):
        step = np.eye(d)[k] * e
        assert abs(log_likelihood(w + step, theta, x, grades) - log_likelihood(w - step, theta, x, grades)) / (2 * e) < 2e-3
    for k in range(2):
        step = np.eye(2)[k] * e
        assert abs(log_likelihood(w, theta + step, x, grades) - log_likelihood(w, theta - step, x, grades)) / (2 * e) < 2e-3
    assert base > log_likelihood(np.zeros(d), theta, x, grades)


def test_expected_grade_is_the_sum_of_the_tails(spark):
    w, theta = np.zeros(quality.SLOTS), np.array([-1.0, 0.5])
    w[quality.features("good", {})] = 0.7
    rows = [(1, "good"), (1, "good"), (2, "bad words here"), (3, None), (4, ""), (None, "good good"), (5, "good " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("tail", F.lit("x"))
    got = quality.predict(docs, {"w": w, "theta": theta}).collect()
    want = []
    for i, t in rows:
        eta = sum(w[k] for k in quality.features(t, {}))
        above = [1 - 1 / (1 + np.exp(-(x - eta))) for x in theta]
        want.append((i, sum(above), above[-1]))
    key = lambda v: (v[0] is None, v[0] or 0, v[1])
    for g, v in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[0] == v[0] and np.allclose(g[1:], v[1:])
    assert quality.predict(docs.limit(0), {"w": w, "theta": theta}).count() == 0
