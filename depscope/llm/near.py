"""Near duplicates: improved consistent weighted sampling over TF-IDF word shingles.

Texts with the same words are collapsed first. Each distinct text is sketched
with K samples, so that two sketches agree in a place with the probability of
their weighted Jaccard similarity. BANDS groups of places are the band keys; all members of a band
are compared with each other, a large band block by block. A candidate link stays if the weighted Jaccard
similarity of the two whole texts is at least the threshold. Classes are
the connected components of the links.

Texts are held in chunks (blobs.py). Document frequencies of the shingles are counted over
all documents by the exchange of sorted fingerprints there; the shingles of two texts
are the same if their fingerprints are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import LOWER_AZ, NOT_SPACE, chunks, free, hash_spans, keyed_texts, mix64, ngram_hash, real_id, released, text_buffer, word_spans
from depscope.llm.blobs import answered, asks, chunked, corpus, fingerprint_bits, from_blob, heads, in_order, pack, ranges, unpack
from depscope.llm.store import settled

SHINGLE = 5
THRESHOLD = 0.8
BANDS, PLACES = 10, 2
K = BANDS * PLACES
#: Candidates agree in so many of K places; at a similarity of 0.8 fewer has a chance of 0.00002, less than that of sharing no band (0.00004).
MIN_AGREE = 8
#: A shingle of fewer than one in RARE documents weighs as one of that many: else the more copies a text has and the larger
#: the table is, the more its copies' own edits outweigh what all of them share.
RARE = 200
#: Bands of up to FEW members are compared many at a time, larger ones in blocks of about BLOCK members.
FEW, BLOCK = 32, 256


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle; a text of fewer words is one shingle, of none has none."""
    buf, off = text_buffer(texts)
    buf = LOWER_AZ[buf]
    starts, ends, of = word_spans(buf, off, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hash_spans(buf, starts, ends, 1)[0]
    g = ngram_hash(h, size)
    at = np.flatnonzero(of[: len(g)] == of[size - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
    count = np.bincount(of, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < size))
    first = np.searchsorted(of, few)
    short = np.array([ngram_hash(h[a : a + c], int(c))[0] for a, c in zip(first, count[few], strict=True)], np.uint64)
    return np.concatenate([g[at], short]), np.concatenate([of[at], few])


def _distinct(g: np.ndarray, of: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, fingerprint of a shingle) by text: fingerprint, text, times."""
    g = g >> np.uint64(64 - bits)
    if bits + (int(of.max(initial=0)) + 1).bit_length() <= 64:
        key = np.sort(of.astype(np.uint64) << np.uint64(bits) | g)
        head = heads(key)
        return key[head] & np.uint64((1 << bits) - 1), (key[head] >> np.uint64(bits)).astype(np.int64), np.diff(np.append(head, len(key)))
    by = np.lexsort((g, of))
    g, of = g[by], of[by]
    head = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (of[1:] != of[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[head], of[head], np.diff(np.append(head, len(g)))


def _inverse(n: int, df: np.ndarray) -> np.ndarray:
    return 1 + np.log((1 + n) / (1 + np.maximum(df, n / RARE)))


def _named(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, tk, node, text): node names the words of a text; of texts with the same words only the first of a chunk stays."""
    buf, off = text_buffer(batch.column("text"))
    buf, off = LOWER_AZ[buf].tobytes(), off.tolist()
    node = [hashlib.md5(b" ".join(buf[s:t].split())).digest() for s, t in zip(off[:-1], off[1:], strict=True)]
    first = set(dict(zip(reversed(node), reversed(range(len(node))), strict=True)).values())
    text = [x if k in first else None for k, x in enumerate(batch.column("text").to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tk"), pa.array(node, pa.binary(16)), pa.array(text, pa.string())], ["id", "tk", "node", "text"])


def chunk_frequencies(stored: DataFrame, bits: int, parts: int) -> DataFrame:
    """(chunk, p, value): in how many documents the distinct shingles of a chunk are, over all chunks, less one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data"), strict=True):
                c = from_blob(data)
                _, of_node, copies = np.unique(np.array(c.column("node").to_pylist(), object), return_inverse=True, return_counts=True)
                g, of, _ = _distinct(*shingles(c.column("text")), bits)
                by = np.argsort(g, kind="stable")
                head = heads(g[by])
                if len(head):
                    n = np.add.reduceat(copies[of_node[of[by]]], head)
                    yield asks(chunk, g[by][head], lambda s, t, n=n: pack(n[s:t] - 1), bits, parts)
            free()

    def summed(keys: np.ndarray, row: np.ndarray, more: list[bytes]) -> list[bytes]:
        n = np.concatenate([unpack(x) for x in more]).astype(np.int64) + 1
        by = np.argsort(keys, kind="stable")
        head = heads(keys[by])
        df = np.empty(len(keys), np.int64)
        df[by] = np.repeat(np.add.reduceat(n[by], head), np.diff(np.append(head, len(keys))))
        cuts = np.searchsorted(row, np.arange(len(more) + 1)).tolist()
        return [pack(df[s:t] - 1) for s, t in zip(cuts[:-1], cuts[1:], strict=True)]

    return answered(stored.mapInArrow(released(counted), "p long, chunk long, keys binary, more binary"), summed)


def sketch(g: np.ndarray, of: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """texts x K samples; g, of sorted by text. A text without shingles gets zeros."""
    out = np.zeros((texts, K), np.uint64)
    if not len(g):
        return out
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    own = of[head]
    number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(g))))
    lw = np.log(weight).astype(np.float32)
    unit = np.float32(2.0**-32)
    for k in range(K):
        a = mix64(g + np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64))
        b = mix64(g + np.uint64(0x9E3779B97F4A7C15 * (2 * k + 2) % 2**64))
        u = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(1)) * unit
        r = -np.log(u(a) * u(a >> np.uint64(32)))
        lc = np.log(-np.log(((b & np.uint64(0xFFFFFF)).astype(np.float32) + 1) * np.float32(2.0**-24) * (((b >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) + 1) * np.float32(2.0**-24 * 0.999)))
        beta = (b >> np.uint64(48)).astype(np.float32) * np.float32(2.0**-16)
        r = np.maximum(r, np.float32(1e-6))
        t = np.floor(lw / r + beta)
        la = lc - r * (t - beta) - r
        least = np.minimum.reduceat(la, head)
        at = np.flatnonzero(la == least[number])
        firsts = at[np.append(True, number[at][1:] != number[at][:-1])]  # ties: the smaller shingle
        out[own, k] = mix64(g[firsts] ^ mix64(t[firsts].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    both, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][x], b[1][y]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 1.0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of the edges; label is the least node of its component."""
    both = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
    labels = settled(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        new = settled(step.join(up, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("up", "next")).alias("label")), "labels")
        if new.filter("old != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _blocks(bands: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell, k, band, block, lo, hi, rid, sketch): each pair of a band's members meets in one cell of it.

    Bands of up to FEW members share cells. A larger one is cut into blocks of about BLOCK members,
    and each pair of blocks (lo, hi) is a cell.
    """
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    many = settled(bands.join(sizes, "band"), "bands")
    cells = 1 + many.filter(F.col("m") <= FEW).count() // (2 * BLOCK)
    few = many.filter(F.col("m") <= FEW).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("band"), F.lit(cells))).alias("cell"), "k", "band", *[F.lit(0).cast("long").alias(x) for x in ("block", "lo", "hi")], "rid")
    cut = F.ceil(F.col("m") / BLOCK)
    large = (
        many.filter(F.col("m") > FEW)
        .select("k", "band", F.pmod(F.xxhash64("rid"), cut).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("other"), "rid")
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    )
    large = large.select(F.concat_ws(":", "band", "lo", "hi").alias("cell"), "k", "band", "block", "lo", "hi", "rid")
    return few.unionByName(large).join(nodes.select("rid", "sketch"), "rid")


def _candidates(cell: pa.Table) -> pa.Table:
    """The pairs of a cell whose sketches agree in MIN_AGREE places; a pair of several bands counts in the first of them."""
    name = cell.column("rid").to_numpy()
    sk = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), "<u4").reshape(-1, K)
    k, band, block, lo, hi = (cell.column(x).to_numpy() for x in ("k", "band", "block", "lo", "hi"))
    by = np.lexsort((block, band))
    cuts = np.flatnonzero(np.diff(band[by])) + 1
    left, right = [], []
    for own in np.split(by, cuts):
        h = own[0]
        across = lo[h] != hi[h]
        x, y = (own[block[own] == lo[h]], own[block[own] == hi[h]]) if across else (own, own)
        if not len(x) or not len(y):
            continue
        same = sk[x][:, None, :] == sk[y][None, :, :]
        bands = same.reshape(len(x), len(y), BANDS, PLACES).all(3)
        ok = (same.sum(2) >= MIN_AGREE) & (bands.argmax(2) == k[h])
        i, j = np.nonzero(ok if across else np.triu(ok, 1))
        left.append(x[i])
        right.append(y[j])
    left, right = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    used, at = np.unique(name[np.concatenate([left, right])], return_inverse=True) if len(left) else ([], left)
    rows = 1 if len(left) else 0
    return pa.table({
        "cell": pa.array([cell.column("cell")[0].as_py()] * rows, pa.string()),
        "members": pa.array([list(used)] * rows, pa.list_(pa.int64())),
        "pairs": pa.array([at.astype("<i4").tobytes()] * rows, pa.binary()),
    })


def _against(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """similarity of one bag to each of the others."""
    g, w = np.concatenate([x[0] for x in others]), np.concatenate([x[1] for x in others])
    at = np.minimum(np.searchsorted(one[0], g), len(one[0]) - 1)
    part = np.where(one[0][at] == g, np.minimum(one[1][at], w), 0)
    heads = np.cumsum([0, *[len(x[0]) for x in others[:-1]]])
    low = np.add.reduceat(part, heads)
    return low / (one[1].sum() + np.add.reduceat(w, heads) - low)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same of n members as all the links do, at most n - 1."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: (id, tk, class_id, class_size, n_links).

    class_id is the least id of the class; n_links the verified links of the
    row's distinct text. Texts with the same words in the same order (A-Z in
    lower case) are of one class, those without words too; null texts count as empty.
    Rows with null ids take part as the smallest id. Tables without rows give none.

    A link is missed if its texts share no band, or agree in fewer than MIN_AGREE of K
    places: together a chance of 0.00006 at a similarity of 0.8, and less above it.
    """
    n_docs, size = corpus(docs, text_col)
    bits, parts = fingerprint_bits(size), ranges(size)
    stored = settled(chunked(keyed_texts(docs, id_col, text_col), _named), "chunks")

    def sketched(texts: pa.Table, counts: pa.Table) -> pa.Table:
        chunk, batch = texts.column("chunk")[0].as_py(), from_blob(texts.column("data")[0])
        g, of, times = _distinct(*shingles(batch.column("text")), bits)
        df = np.zeros(len(g), np.int64)
        if len(g):
            by = np.argsort(g, kind="stable")
            head = heads(g[by])
            known = np.concatenate([unpack(x) for x in in_order(counts)]).astype(np.int64) + 1
            df[by] = np.repeat(known, np.diff(np.append(head, len(g))))
        only = np.flatnonzero(batch.column("text").is_valid().to_numpy(zero_copy_only=False))
        lists, counted = [None] * batch.num_rows, [None] * batch.num_rows
        ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
        for a in range(0, len(only), 512):
            part = only[a : a + 512]
            s, t = ends[part[0]], ends[part[-1] + 1]
            sk = sketch(g[s:t], of[s:t] - part[0], times[s:t] * _inverse(n_docs, df[s:t]), int(part[-1] - part[0] + 1))
            for k in part.tolist():
                lists[k] = (sk[k - part[0]] >> np.uint64(32)).astype("<u4").tobytes()
                counted[k] = pack(df[ends[k] : ends[k + 1]] - 1)
        rid = pa.array((chunk << 22) + np.arange(batch.num_rows))
        free()
        return pa.table([batch.column("id"), batch.column("tk"), batch.column("node").cast(pa.binary()), rid, pa.array(lists, pa.binary()), pa.array(counted, pa.binary())], ["id", "tk", "node", "rid", "sketch", "df"])

    def bags(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        """The shingles of the wanted texts of a chunk, for each cell that compares them."""
        batch = from_blob(texts.column("data")[0])
        out: list[tuple] = []
        if wanted.num_rows:
            for r in wanted.to_pylist():
                g, _, times = _distinct(*shingles(batch.column("text").slice(r["rid"] & (1 << 22) - 1, 1)), bits)
                keys, times = pack(np.diff(g, prepend=np.uint64(0))), pack(times)
                out += [(c, r["rid"], keys, times, r["df"]) for c in r["cells"]]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["cell", "rid", "keys", "times", "df"])

    def verified(found: pa.Table, held: pa.Table) -> pa.Table:
        name = found.column("members")[0].as_py()
        place = {x: k for k, x in enumerate(name)}
        bag: list = [None] * len(name)
        for rid, keys, times, df in zip(*(held.column(c).to_pylist() for c in ("rid", "keys", "times", "df")), strict=True):
            bag[place[rid]] = np.cumsum(unpack(keys)), unpack(times) * _inverse(n_docs, unpack(df).astype(np.int64) + 1)
        pairs = np.frombuffer(found.column("pairs")[0].as_py(), "<i4").reshape(2, -1)
        left, right = pairs.min(0), pairs.max(0)
        by = np.argsort(left, kind="stable")
        left, right = left[by], right[by]
        ok = np.zeros(len(left), bool)
        cuts = np.append(np.flatnonzero(np.diff(left, prepend=-1)), len(left))
        for s, t in zip(cuts[:-1], cuts[1:], strict=True):
            for a in range(s, t, 64):
                b = min(t, a + 64)
                ok[a:b] = _against(bag[left[s]], [bag[x] for x in right[a:b]]) >= threshold
        left, right = left[ok], right[ok]
        degree = np.bincount(np.concatenate([left, right]), minlength=len(name))
        on = np.flatnonzero(degree).tolist()
        forest = _forest(len(name), left, right)
        return pa.table({
            "a": pa.array([name[x] for x in on] + [name[x] for x, _ in forest], pa.int64()),
            "b": pa.array([None] * len(on) + [name[y] for _, y in forest], pa.int64()),
            "n": pa.array(degree[on].tolist() + [None] * len(forest), pa.int64()),
        })

    shared = chunk_frequencies(stored, bits, parts)
    members = settled(stored.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(sketched, "id long, tk long, node binary, rid long, sketch binary, df binary"), "sketches")
    # rid, the place of a text's first copy, names the text from here on
    nodes = settled(members.filter("sketch is not null").groupBy("node").agg(F.min(F.struct("rid", "sketch", "df")).alias("s")).select("node", "s.*"), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 4 * PLACES * i + 1, 4 * PLACES)) for i in range(BANDS)])
    bands = nodes.filter(F.col("sketch") != F.lit(bytes(4 * K))).select("rid", F.posexplode(keys).alias("k", "band"))
    found = settled(_blocks(bands, nodes).groupBy("cell").applyInArrow(_candidates, "cell string, members array<long>, pairs binary"), "candidates")
    wanted = found.select("cell", F.explode("members").alias("rid")).groupBy("rid").agg(F.collect_list("cell").alias("cells"))  # the cells of a text: blocks of its ten bands
    wanted = wanted.join(nodes.select("rid", "df"), "rid").select(F.shiftright("rid", 22).alias("chunk"), "rid", "cells", "df")
    held = stored.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(bags, "cell string, rid long, keys binary, times binary, df binary")
    # degrees of the members (b null) and links that join the same members as all links of a cell
    judged = settled(found.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(verified, "a long, b long, n long"), "links")
    labels = components(judged.filter("b is not null").select("a", "b"))
    degree = judged.filter("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    of_node = nodes.select("node", "rid").join(labels.withColumnRenamed("node", "rid"), "rid", "left").join(degree, "rid", "left").select("node", F.coalesce("label", "rid").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = settled(members.select("id", "tk", "node").join(of_node, "node").select("id", "tk", "label", "n_links"), "classes")
    of_class = rows.groupBy("label").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(of_class, "label").select("id", "tk", "class_id", "class_size", "n_links")


def class_columns(found: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, n_links)"""
    return found.select(real_id().alias("doc_id"), real_id("class_id").alias("class_id"), "class_size", "n_links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class with all its columns: that of the least id (of one id, the least text hash)."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    pick = found.groupBy("class_id").agg(F.min(F.struct("id", "tk")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.tk").alias("__tk"))
    from depscope.llm.decontam import keyed_id

    tagged = docs.withColumns({"__id": keyed_id(docs, id_col), "__tk": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return tagged.join(pick, ["__id", "__tk"], "left_semi").dropDuplicates(["__id", "__tk"]).select(*docs.columns)
