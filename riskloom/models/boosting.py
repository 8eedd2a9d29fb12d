"""Gradient-boosted trees on binned rows: MLlib's algorithm with fewer jobs (ML-1, ML-2).

The trees are those of MLlib's ``GBTClassifier``: log loss on labels -1 and +1, the first
tree on the labels with weight 1, the others on the residuals with the step size, splits
of at most ``maxBins`` bins by variance gain on weighted sums, rows drawn per tree and
features per node.  The result is an MLlib model (through its saved format).  MLlib runs a
job per level of a tree whatever the table's size, 0.6 s a tree and more; at 600 trees
that is most of a fit.  Here

* a table of at most ``TASK_ROWS`` rows is fitted within one task, so that independent
  fits share the cores;
* a larger one is dealt into parts of at most ``TASK_ROWS`` rows that stay on the executors
  as bin numbers; a job per level adds up their histograms, a few MB whatever the rows.

Bin edges come from all rows: every value of a feature of up to ``SKETCH`` different ones,
else quantiles to within 2 / ``SKETCH`` of the rows.  A histogram is made for the smaller of
two siblings, the other is the parent's less that.  Features of few bins share a code
(``CODES`` at most) and their histograms are sums over the joint one.
"""

from __future__ import annotations

import json
import math
import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from riskloom.session import TASK_ROWS, drop_scratch, ensure_checkpoint_dir, scratch_path

#: Points kept of a feature's values, bins of features that share a code, rows worked on
#: together, trees between two checkpoints of the margins.
SKETCH, CODES, CHUNK, KEEP_TREES = 4_096, 1_024, 1 << 16, 10
#: Up to so many rows, adding up large joint histograms costs more than making small ones.
FEW_ROWS = 30_000


@dataclass(frozen=True)
class Params:
    """MLlib's parameters of the same names, with its defaults."""

    maxIter: int
    maxDepth: int = 5
    stepSize: float = 0.1
    minInstancesPerNode: int = 1
    subsamplingRate: float = 1.0
    featureSubsetStrategy: str = "all"
    maxBins: int = 32
    seed: int = 0

    def per_node(self, n_features: int) -> int:
        s = self.featureSubsetStrategy
        return n_features if s == "all" else min(n_features, math.ceil(float(s) * n_features))


# ---- rows as they come ---------------------------------------------------------
def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (rows x features), labels and weights of (features, label, weight)."""
    lists, label, weight = batch.column(0), batch.column(1), batch.column(2)
    flat = lists.flatten()
    if lists.null_count or flat.null_count or label.null_count or weight.null_count:
        raise ValueError("features, labels and weights must not be null")
    x = flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    y, w = label.to_numpy(zero_copy_only=False), weight.to_numpy(zero_copy_only=False)
    if not np.isfinite(x).all() or not np.isin(y, (0.0, 1.0)).all() or not (np.isfinite(w) & (w >= 0)).all():
        raise ValueError("features must be finite, labels 0 or 1, weights not negative")
    return x, y, w


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    got = [_columns(b) for b in batches if b.num_rows]
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else None


# ---- bin edges -----------------------------------------------------------------
def _thin(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``SKETCH`` of sorted points, each with the count of those it stands for."""
    if len(values) <= SKETCH:
        return values, counts
    below = np.cumsum(counts)
    at = np.unique(np.searchsorted(below, np.arange(1, SKETCH + 1) * (below[-1] / SKETCH) * (1 - 1e-12)))
    return values[at], np.diff(below[at], prepend=0)


def _merge(sketches: Sequence[list]) -> list:
    """One sketch (values and counts per feature) of several."""
    out = []
    for parts in zip(*sketches, strict=True):
        values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        out.append(_thin(values, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)))
    return out


def sketch_of(x: np.ndarray) -> list:
    """Sorted values and their counts, per feature."""
    return [_thin(*np.unique(x[:, f], return_counts=True)) for f in range(x.shape[1])]


def edges_of(sketch: list, max_bins: int) -> list[np.ndarray]:
    """Thresholds per feature, between neighbouring values: between all where there are
    few, else about equal counts apart."""
    out = []
    for values, counts in sketch:
        values = values.astype(np.float64)
        below = np.cumsum(counts)
        if len(values) > max_bins:
            at = np.unique(np.searchsorted(below, np.arange(1, max_bins) * (below[-1] / max_bins)))
            at = at[at < len(values) - 1]
        else:
            at = np.arange(len(values) - 1)
        out.append((values[at] + values[at + 1]) / 2)
    return out


# ---- binned rows ---------------------------------------------------------------
@dataclass
class Layout:
    """Which features share a code: per code their numbers and numbers of bins."""

    edges: list[np.ndarray]
    n_rows: int
    groups: list[tuple[tuple[int, ...], tuple[int, ...]]] = field(init=False)
    place: dict[int, tuple[int, int, int]] = field(init=False)  # feature -> code, divisor, bins

    def __post_init__(self):
        bins = [len(e) + 1 for e in self.edges]
        most = CODES if self.n_rows > FEW_ROWS else 64
        open_groups: list[list[int]] = []
        for f in sorted((f for f in range(len(bins)) if bins[f] > 1), key=lambda f: (-bins[f], f)):
            fit = next((g for g in open_groups if math.prod(bins[i] for i in g) * bins[f] <= most), None)
            fit.append(f) if fit else open_groups.append([f])
        self.groups = [(tuple(g), tuple(bins[f] for f in g)) for g in open_groups]
        self.place = {f: (k, math.prod(shape[i + 1:]), shape[i]) for k, (g, shape) in enumerate(self.groups) for i, f in enumerate(g)}
        self.width = max(bins)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes x rows; a value equal to a threshold lies left of it."""
        out = np.zeros((len(self.groups), x.shape[0]), dtype=np.uint16)
        for f, (k, div, _) in self.place.items():
            out[k] += (np.searchsorted(self.edges[f], x[:, f]) * div).astype(np.uint16)
        return out


@dataclass
class Rows:
    """Rows of one part: codes, label as -1 or +1, weight, margin so far."""

    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margin: np.ndarray

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, w: np.ndarray, layout: Layout) -> Rows:
        """Sorted, so that a fit does not depend on the order in which rows arrive."""
        codes = layout.codes(x)
        order = np.lexsort((w, y, *codes))
        return Rows(np.ascontiguousarray(codes[:, order]), (2.0 * y - 1.0)[order], w[order].astype(np.float64), np.zeros(len(y)))

    def begin(self, p: Params, tree: int, part: int) -> None:
        """Residuals and the drawn rows of a tree; all rows at its root."""
        n = len(self.y)
        target = self.y if tree == 0 else 4.0 * self.y / (1.0 + np.exp(2.0 * self.y * self.margin))
        self.wt = self.w * target
        rng = np.random.default_rng((p.seed + tree) * 1_000_003 + part)
        self.drawn = rng.random(n) < p.subsamplingRate if p.subsamplingRate < 1 else np.ones(n, dtype=bool)
        self.node = np.zeros(n, dtype=np.int32)

    def advance(self, t: Tree, layout: Layout, nodes: Sequence[int]) -> None:
        """Rows at the nodes just split go to the children."""
        left, low = np.asarray(t.left, dtype=np.int32), nodes[0]
        split = [i for i in nodes if left[i] >= 0]
        if not split:
            return
        # what is right of the split, by node and code, of the node's own feature
        right = np.zeros((nodes[-1] + 1 - low, CODES), dtype=np.int8)
        which = np.zeros(nodes[-1] + 1 - low, dtype=np.intp)
        for i in split:
            k, div, bins = layout.place[t.feature[i]]
            which[i - low] = k
            codes = np.arange(math.prod(layout.groups[k][1]))
            right[i - low, :len(codes)] = codes // div % bins > t.bin[i]
        for a in range(0, len(self.node), CHUNK):
            node = self.node[a:a + CHUNK]
            at = np.flatnonzero((node >= low) & (left[node] >= 0))
            here = node[at] - low
            code = self.codes.ravel().take(which.take(here) * len(self.y) + (a + at))
            node[at] = left.take(here + low) + right.ravel().take(here * np.intp(CODES) + code)

    def histograms(self, layout: Layout, slot: np.ndarray, n_slots: int) -> list[np.ndarray]:
        """Per code: count, weight, weighted target by slot and code of the drawn rows;
        ``slot`` gives a node's slot, or -1."""
        out = [np.zeros((3, n_slots * math.prod(shape))) for _, shape in layout.groups]
        for a in range(0, len(self.node), CHUNK):
            s = slot[self.node[a:a + CHUNK]]
            at = np.flatnonzero((s >= 0) & self.drawn[a:a + CHUNK])
            s, w, wt = s[at], self.w[a:a + CHUNK][at], self.wt[a:a + CHUNK][at]
            for k, h in enumerate(out):
                size = h.shape[1] // n_slots
                i = s * size + self.codes[k, a:a + CHUNK][at]
                h[0] += np.bincount(i, minlength=h.shape[1])
                h[1] += np.bincount(i, w, h.shape[1])
                h[2] += np.bincount(i, wt, h.shape[1])
        if not out:  # no feature has two values: the totals alone
            drawn = self.drawn
            out = [np.array([[drawn.sum()], [self.w[drawn].sum()], [self.wt[drawn].sum()]])]
        return out

    def end(self, t: Tree, weight: float) -> None:
        self.margin = self.margin + weight * np.asarray(t.value)[self.node]


def by_feature(hists: list[np.ndarray], layout: Layout, n_slots: int) -> np.ndarray:
    """Slots x 3 x features x bins from the joint histograms."""
    out = np.zeros((n_slots, 3, len(layout.edges), layout.width))
    for h, (features, shape) in zip(hists, layout.groups, strict=False):
        h = h.reshape(3, n_slots, *shape)
        for i, f in enumerate(features):
            others = tuple(2 + j for j in range(len(shape)) if j != i)
            out[:, :, f, :shape[i]] = h.sum(axis=others).transpose(1, 0, 2)
    total = hists[0].reshape(3, n_slots, -1).sum(axis=2).T
    for f in range(len(layout.edges)):
        if f not in layout.place:  # one value: all rows in its bin
            out[:, :, f, 0] = total
    return out


# ---- trees ---------------------------------------------------------------------
@dataclass
class Tree:
    """Nodes level by level; ``left`` is -1 at a leaf, else the right child is next to it."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    stats: list[tuple[float, float, float]] = field(default_factory=list)  # count, weight, sum
    gain: list[float] = field(default_factory=list)
    levels: list[list[int]] = field(default_factory=list)  # nodes that could be split, by depth

    def add(self, stats: np.ndarray) -> int:
        n, w, s = (float(v) for v in stats)
        for column, v in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.value, s / w if w > 0 else 0.0),
                          (self.stats, (n, w, s)), (self.gain, -1.0)):
            column.append(v)
        return len(self.left) - 1


def _split(t: Tree, nodes: Sequence[int], hist: np.ndarray, p: Params, rng: np.random.Generator) -> list[int]:
    """Split what can be split among ``nodes`` (their histograms in ``hist``); the children."""
    n_features = hist.shape[2]
    some = p.per_node(n_features)
    allowed = np.ones((len(nodes), n_features), dtype=bool)
    if some < n_features:
        rank = rng.random((len(nodes), n_features)).argsort(axis=1).argsort(axis=1)
        allowed = rank < some
    total = hist[:, :, :1].sum(axis=3)                      # nodes x 3 x 1
    left = hist[..., :-1].cumsum(axis=3)                    # nodes x 3 x features x thresholds
    right = total[..., None] - left
    (ln, lw, ls), (rn, rw, rs) = (a.transpose(1, 0, 2, 3) for a in (left, right))
    n, w, s = total[:, 0, 0], total[:, 1, 0], total[:, 2, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(w > 0, s * s / w, 0.0)
        score = ls * ls / lw + rs * rs / rw - whole[:, None, None]
        ok = (ln >= p.minInstancesPerNode) & (rn >= p.minInstancesPerNode) & (lw > 0) & (rw > 0) & allowed[:, :, None]
        flat = np.where(ok, score, -np.inf).reshape(len(nodes), -1)
    children = []
    best = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(nodes), dtype=int)
    for j, i in enumerate(nodes):
        # a gain within the sums' rounding is none
        if not flat.shape[1] or not flat[j, best[j]] > 1e-10 * whole[j]:
            continue
        f, b = divmod(int(best[j]), hist.shape[3] - 1)
        t.feature[i], t.bin[i], t.gain[i] = f, b, float(flat[j, best[j]] / w[j])
        t.left[i] = t.add(left[j, :, f, b])
        children += [t.left[i], t.add(right[j, :, f, b])]
    return children


def grow(p: Params, tree: int, sums) -> Tree:
    """One tree; ``sums(t, levels, slot, n_slots)`` gives the histograms by feature of all
    rows, after they went down the ``levels`` split so far."""
    rng = np.random.default_rng([p.seed + tree, 7])
    t = Tree()
    hist = sums(t, [], np.zeros(1, dtype=np.int64), 1)
    nodes = [t.add(hist[0, :, 0].sum(axis=1))]
    for depth in range(p.maxDepth):
        children = _split(t, nodes, hist, p, rng)
        t.levels.append(nodes)
        if not children or depth == p.maxDepth - 1:
            break
        # the smaller of two siblings is counted, the other one is what remains
        slot, parent = np.full(len(t.left), -1, dtype=np.int64), {t.left[i]: j for j, i in enumerate(nodes) if t.left[i] >= 0}
        small = [a if t.stats[a][0] <= t.stats[a + 1][0] else a + 1 for a in children[::2]]
        slot[small] = np.arange(len(small))
        counted = sums(t, t.levels, slot, len(small))
        rest = hist[[parent[a] for a in children[::2]]] - counted
        first = np.array([s == a for s, a in zip(small, children[::2], strict=True)])[:, None, None, None]
        hist = np.stack([np.where(first, counted, rest), np.where(first, rest, counted)], axis=1).reshape(-1, *hist.shape[1:])
        nodes = children
    return t


def _weight(p: Params, tree: int) -> float:
    return 1.0 if tree == 0 else p.stepSize


# ---- one task, or one job per level --------------------------------------------
def _boost_here(rows: Rows, layout: Layout, p: Params) -> list[Tree]:
    trees = []
    for k in range(p.maxIter):
        rows.begin(p, k, 0)
        done = 0

        def sums(t, levels, slot, n_slots):
            nonlocal done
            for nodes in levels[done:]:
                rows.advance(t, layout, nodes)
            done = len(levels)
            return by_feature(rows.histograms(layout, slot, n_slots), layout, n_slots)

        t = grow(p, k, sums)
        for nodes in t.levels[done:]:
            rows.advance(t, layout, nodes)
        rows.end(t, _weight(p, k))
        trees.append(t)
    return trees


def _boost_parts(rows: RDD, layout: Layout, p: Params, spark: SparkSession) -> list[Tree]:
    """``rows`` has one :class:`Rows` a partition.  After a tree they are persisted anew
    with their margins, now and then written to the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared, trees, kept = spark.sparkContext.broadcast(layout), [], None
    depth = 1 if rows.getNumPartitions() <= 64 else 2  # histograms that one process adds up

    def begun(part: int, some) -> Iterator[Rows]:
        for r in some:
            r.begin(p, 0, part)
            yield r

    state = rows.mapPartitionsWithIndex(begun).persist(StorageLevel.MEMORY_AND_DISK)
    for k in range(p.maxIter):
        def sums(t, levels, slot, n_slots, state=state):
            levels = list(levels)

            def counted(r: Rows) -> np.ndarray:
                for nodes in levels:
                    r.advance(t, shared.value, nodes)
                return by_feature(r.histograms(shared.value, slot, n_slots), shared.value, n_slots)

            return state.map(counted).treeReduce(np.add, depth)

        t = grow(p, k, sums)
        trees.append(t)
        if k + 1 == p.maxIter:
            break

        def ended(part: int, some, k=k, t=t) -> Iterator[Rows]:
            for r in some:
                for nodes in t.levels:
                    r.advance(t, shared.value, nodes)
                r.end(t, _weight(p, k))
                r.begin(p, k + 1, part)
                yield r

        after, old = state.mapPartitionsWithIndex(ended).persist(StorageLevel.MEMORY_AND_DISK), state
        write = (k + 1) % KEEP_TREES == 0
        if write:
            after.checkpoint()
        after.count()
        old.unpersist()
        state = after
        if write:
            if kept:
                drop_scratch(spark, kept)
            kept = after.getCheckpointFile()
    state.unpersist()
    if kept:
        drop_scratch(spark, kept)
    shared.unpersist()
    return trees


def fit(data: DataFrame, p: Params) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees and bin edges of (features array, label, weight)."""
    spark, n = data.sparkSession, data.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    if p.maxBins > CODES:
        raise ValueError(f"at most {CODES} bins")
    if n <= TASK_ROWS:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _rows(batches)
            if got:
                layout = Layout(edges_of(sketch_of(got[0]), p.maxBins), n)
                trees = _boost_here(Rows.of(*got, layout), layout, p)
                yield pa.RecordBatch.from_pydict({"model": [pickle.dumps((trees, layout.edges))]})

        return pickle.loads(data.repartition(1).mapInArrow(whole, "model binary").collect()[0]["model"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, sketch = [], 0, None
        for b in batches:
            if b.num_rows:
                held.append(_columns(b)[0])
                n_held += b.num_rows
            if n_held >= TASK_ROWS:
                new = sketch_of(np.concatenate(held))
                sketch, held, n_held = _merge([sketch, new]) if sketch else new, [], 0
        if held:
            new = sketch_of(np.concatenate(held))
            sketch = _merge([sketch, new]) if sketch else new
        if sketch:
            yield pa.RecordBatch.from_pydict({"sketch": [pickle.dumps(sketch)]})

    # 4,096 points a feature and partition
    found = [pickle.loads(r["sketch"]) for r in data.mapInArrow(sketched, "sketch binary").toLocalIterator()]
    layout = Layout(edges_of(_merge(found), p.maxBins), n)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _rows(batches)
        if got:
            yield pa.RecordBatch.from_pydict({"rows": [pickle.dumps(Rows.of(*got, layout))]})

    parts = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    rows = data.repartition(parts).mapInArrow(packed, "rows binary").rdd.map(lambda r: pickle.loads(r["rows"]))
    return _boost_parts(rows, layout, p, spark), layout.edges


# ---- as an MLlib model ---------------------------------------------------------
def to_mllib(spark: SparkSession, trees: list[Tree], edges: list[np.ndarray], p: Params, label: str, vector: str) -> GBTClassificationModel:
    """The trees in MLlib's saved format, loaded.  A node keeps weight and sum (not the
    sum of squares, so no impurity)."""
    ids = [len(t.left) for t in trees]
    flat = lambda name: [v for t in trees for v in getattr(t, name)]
    left, feature, bins, stats = flat("left"), flat("feature"), flat("bin"), flat("stats")
    size = len(left)
    split = pa.StructArray.from_arrays(
        [pa.array(feature, pa.int32()),
         pa.array([[float(edges[f][b])] if f >= 0 else [] for f, b in zip(feature, bins, strict=True)], pa.list_(pa.float64())),
         pa.array([-1] * size, pa.int32())], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays(
        [pa.array([i for n in ids for i in range(n)], pa.int32()), pa.array(flat("value"), pa.float64()), pa.array([0.0] * size),
         pa.array([[w, s, 0.0] for _, w, s in stats], pa.list_(pa.float64())), pa.array([int(n) for n, _, _ in stats], pa.int64()),
         pa.array(flat("gain"), pa.float64()), pa.array(left, pa.int32()), pa.array([i + 1 if i >= 0 else -1 for i in left], pa.int32()), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    uid = f"gbt_{uuid.uuid4().hex[:12]}"
    params = {"impurity": "variance", "featuresCol": vector, "labelCol": label, "maxIter": p.maxIter, "maxDepth": p.maxDepth, "stepSize": p.stepSize,
              "minInstancesPerNode": p.minInstancesPerNode, "subsamplingRate": p.subsamplingRate,
              "featureSubsetStrategy": p.featureSubsetStrategy, "maxBins": p.maxBins, "seed": p.seed}
    meta = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": params, "defaultParamMap": {}}
    small = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": {"impurity": "variance"}, "defaultParamMap": {}}
    path = scratch_path(spark, uid)
    top = meta | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": uid, "numFeatures": len(edges), "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    part = [(i, json.dumps(small | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"{uid}_{i}"}), _weight(p, i))
            for i in range(len(trees))]
    spark.createDataFrame(part, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    table = pa.table({"treeID": pa.array([i for i, n in enumerate(ids) for _ in range(n)], pa.int32()), "nodeData": node})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/data")
    model = GBTClassificationModel.load(path)
    drop_scratch(spark, path)
    return model
