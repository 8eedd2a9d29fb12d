"""Embedding near-dedup by int8 quantised tile products.

Equal vectors are one class, compared once and counted by their number.  Classes
are put into the cell of their nearest pivot (pivots are a bounded sample) and
cells into tiles of about ``TILE_BYTES``.  A tile meets the tiles of those cells
where the hyperplane bound lets one of its vectors have a partner; the bound is
exact, so no pair is lost, and where it prunes nothing all tiles meet.

For two tiles the unit vectors are quantised to int8 with one scale per vector.
With e the norm of a vector's quantisation error and m the norm of its quantised
form, |u.v - u'.v'| <= e_u m_v + m_u e_v + e_u e_v, so one product of the
quantised rows extended by these three terms bounds every cosine from above;
only pairs whose bound reaches the threshold are computed in double precision.
(numpy has no int8 product; the int8 values are multiplied as float32, and the
rounding of that is added to the bound.)

A pair of tiles returns per vector how many vectors it links with, and a star
forest of what is connected, at most one edge per vector: pairs are counted, never
written out.

Defined results: a vector that is null, zero, empty, or holds null or non-finite
components links with nothing, as does one without vec_id (its component_id is
null); vectors of different lengths do not link; repeated rows are vectors of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C

THRESHOLD = 0.95
#: Size of a tile's vectors; the shuffle falls, and a task's memory grows, with it.
TILE_BYTES = 4 << 20
#: Pivots are collected and sent to all tasks: at most so many vectors.
MAX_PIVOTS = 1024
_BLOCK = 1024


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / np.where(top > 0, top, 1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _cells(batches, pivots: dict[int, np.ndarray], reach: float, kind: str):
    """Cell of each class and the cells where a partner may be; the vector as
    bytes of its own precision."""
    for pdf in batches:
        parts = []
        for d, idx in pdf.groupby("d").indices.items():
            p = pdf.iloc[idx]
            v = np.array(p["embedding"].tolist(), dtype=np.float64).reshape(len(p), d)
            u, piv = unit_rows(v), pivots[d]
            dot = u @ piv.T
            own = dot.argmax(axis=1)
            # Distance from the plane between the own and another pivot; beyond it nothing within reach.
            apart = np.sqrt(np.maximum(2 - 2 * piv @ piv.T, 1e-30))
            gap = (dot[np.arange(len(u)), own][:, None] - dot) / apart[own]
            near = gap <= reach + 1e-9
            near[np.arange(len(u)), own] = True
            parts.append(pd.DataFrame({"cid": p["cid"].to_numpy(), "n": p["n"].to_numpy(), "d": d, "cell": own,
                                       "near": [np.flatnonzero(r) for r in near],
                                       "v": [r.tobytes() for r in v.astype(kind)]}))
        if parts:
            yield pd.concat(parts)


def _pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per tile."""
    return pd.DataFrame({"d": [key[0]], "cell": [key[1]], "tile": [key[2]],
                         "near": [np.unique(np.concatenate(pdf["near"].tolist()))],
                         "cids": [pdf["cid"].to_numpy(np.int64).tobytes()], "sizes": [pdf["n"].to_numpy(np.int64).tobytes()],
                         "vecs": [b"".join(pdf["v"])]})


def _quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The quantised rows, extended for the left and for the right of a product."""
    scale = np.abs(u).max(axis=1, keepdims=True) / 127
    q = np.rint(u / scale).astype(np.int8)
    near = q * scale
    e = np.sqrt(((u - near) ** 2).sum(axis=1, keepdims=True)) + 1e-12
    m = np.sqrt((near**2).sum(axis=1, keepdims=True))
    return np.hstack([near, e, m, e]).astype(np.float32), np.hstack([near, m, e, e]).astype(np.float32)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs of rows of x and y, or within x for None."""
    ux = unit_rows(x)
    uy = ux if y is None else unit_rows(y)
    left, right = _quantised(ux)[0], _quantised(uy)[1]
    least = np.float32(threshold - 1e-6 - (x.shape[1] + 3) * 2.0**-22)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(ux), _BLOCK):
        for j in range(i if y is None else 0, len(uy), _BLOCK):
            a, b = np.nonzero(left[i:i + _BLOCK] @ right[j:j + _BLOCK].T >= least)
            a, b = a + i, b + j
            if y is None:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 17):
                p, q = a[k:k + (1 << 17)], b[k:k + (1 << 17)]
                ok = np.einsum("ij,ij->i", ux[p], uy[q]) >= threshold
                out.append((p[ok], q[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node of 0..n-1 the smallest index that the edges connect it with."""
    f = np.arange(n)
    while True:
        g = f.copy()
        low = np.minimum(f[a], f[b])
        for at in (a, b, f[a], f[b]):
            np.minimum.at(g, at, low)
        g = g[g]
        if (g == f).all():
            return f
        f = g


def _compare(pdf: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """Links of a pair of tiles (its one or two rows): per vector their number and
    the first vector that they connect it with."""
    pdf = pdf.sort_values("side")
    ids = [np.frombuffer(x, np.int64) for x in pdf["cids"]]
    vecs = [np.frombuffer(x, kind).reshape(len(i), -1) for x, i in zip(pdf["vecs"], ids, strict=True)]
    a, b = tile_links(vecs[0], vecs[1] if len(vecs) > 1 else None, threshold)
    if len(vecs) > 1:
        b = b + len(ids[0])
    ids, sizes = np.concatenate(ids), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["sizes"]])
    links = np.bincount(a, sizes[b], len(ids)) + np.bincount(b, sizes[a], len(ids))
    hit = links > 0
    return pd.DataFrame({"cid": ids[hit], "other": ids[_smallest(len(ids), a, b)][hit], "links": links[hit].astype(np.int64)})


def links_and_components(vectors: DataFrame, scratch: C.Scratch, threshold: float = THRESHOLD,
                         tile_rows: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "f4" if element == "float" else "f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("k1", F.xxhash64("embedding")).withColumn(
        "k2", F.xxhash64(F.lit(1), "embedding"))
    classes = (v.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                                      F.first("embedding").alias("embedding"))
               .withColumn("d", F.size("embedding")))
    classes = scratch.cut(classes.withColumnRenamed("k1", "cid"), "classes")
    per_dim = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = spark.createDataFrame([], "cid long, other long, links long")
    if per_dim:
        pivots, rows = {}, {}
        for d, n in per_dim.items():
            rows[d] = tile_rows or max(256, TILE_BYTES // (int(kind[1]) * d))
            want = max(1, min(MAX_PIVOTS, n // rows[d]))
            some = C.hash_sample(classes.where(F.col("d") == d), F.col("cid"), want, n).select("embedding").collect()
            pivots[d] = np.unique(unit_rows(np.array([r[0] for r in some], dtype=np.float64)), axis=0)
        reach = float(np.sqrt(2 - 2 * threshold))
        at = scratch.cut(classes.select("cid", "n", "d", "embedding").mapInPandas(
            lambda it: _cells(it, pivots, reach, kind), "cid long, n long, d int, cell int, near array<int>, v binary"), "cells")
        sizes = at.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("held"))
        per_tile = F.element_at(F.create_map(*[F.lit(x) for item in rows.items() for x in item]), F.col("d"))
        sizes = sizes.select("d", "cell", F.ceil(F.col("held") / per_tile).cast("long").alias("tiles"))
        at = at.join(F.broadcast(sizes), ["d", "cell"])  # at most MAX_PIVOTS rows per dimension
        tiles = scratch.cut(at.withColumn("tile", F.pmod("cid", "tiles")).groupBy("d", "cell", "tile").applyInPandas(
            _pack, "d int, cell int, tile long, near array<int>, cids binary, sizes binary, vecs binary"), "tiles")
        one = tiles.select("d", "cell", "tile", F.explode("near").alias("cell2"))
        two = tiles.select("d", F.col("cell").alias("cell2"), F.col("tile").alias("tile2"))
        pairs = scratch.cut(one.join(two, ["d", "cell2"]).where("cell < cell2 OR (cell = cell2 AND tile <= tile2)"), "pairs")
        # Each tile goes once to each of its pairs.
        pair, data = ["d", "cell", "tile", "cell2", "tile2"], ["cids", "sizes", "vecs"]
        one = pairs.join(tiles, ["d", "cell", "tile"]).select(*pair, F.lit(0).alias("side"), *data)
        other = tiles.select("d", F.col("cell").alias("cell2"), F.col("tile").alias("tile2"), *data)
        two = (pairs.where("cell <> cell2 OR tile <> tile2").join(other, ["d", "cell2", "tile2"])
               .select(*pair, F.lit(1).alias("side"), *data))
        work = one.unionByName(two).groupBy(*pair)
        found = scratch.cut(work.applyInPandas(lambda pdf: _compare(pdf, threshold, kind), "cid long, other long, links long"), "found")
        scratch.drop("cells", "tiles", "pairs")
    comp = C.components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")), scratch)
    per_class = (classes.select("cid", "k2", "rep", "n")
                 .join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
                 .join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                 .withColumn("component", F.coalesce("component", "cid")))
    smallest = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = per_class.join(smallest, "component").select(
        F.col("cid").alias("k1"), "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = v.where("good").select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(v.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                         F.col("vec_id").alias("component_id")))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = links_and_components(C.table(spark, sf_dir, "embeddings"), C.Scratch(spark, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b
         ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
