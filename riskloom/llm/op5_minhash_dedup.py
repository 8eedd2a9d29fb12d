"""MinHash near-dedup with an LSH forest.

Documents with equal shingle sets are one class.  Classes are linked from a
similarity on that the caller chooses (``Links``): the query op5 links at 0.85
(``THIN``), the pipeline's stage at 0.8 (``STAGE``), and the number of trees and the
bound on estimates go with it.  A class's signature has
``trees`` x ``DEPTH`` MinHash values; each tree orders the classes by its own
``DEPTH`` values, and classes that share a prefix of that order are candidates.
The prefix is as deep as the region asks for: it starts at ``MIN_DEPTH`` values,
and where more than ``REGION`` classes share it, one value more is asked of them,
and so on; regions that differ only in their tree are merged.  What still shares
all values in a crowd is split into blocks that are joined through a hub.

Inside a region signatures estimate the similarity of all pairs, in one small
task.  First a spanning forest of the likely pairs is confirmed on the full
shingle sets.  Then every region that still has a likely pair between different
components gets its members' sets, compares all of them at once (a product of the
incidence matrix with itself) and returns a spanning forest of the links it finds;
a crowd's members outside its main component meet all its blocks there.  Pairs
within one component need no check, as only what is connected is asked, and no
step writes out all pairs of a region.  Signatures rule out a pair only below
``likely``, more than four standard errors under the threshold.

Defined results: null text, or one without words, has an empty set and links
with nothing; with fewer than five words the whole sequence is the one shingle;
a document without doc_id links with nothing (component_id is null); repeated
rows are documents of their own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C

SHINGLE = 5
DEPTH, MIN_DEPTH = 8, 4
#: Classes that one region may hold before a deeper prefix is asked for.
REGION = 256


class Links(NamedTuple):
    """Similarity in per cent from which classes are linked, estimate from which a
    pair is confirmed on the full sets, and trees of the forest."""

    percent: int
    likely: float
    trees: int


#: At its threshold either misses a pair with under 1e-5 by MIN_DEPTH values and under 1 % by DEPTH.
THIN, STAGE = Links(85, 0.7, 16), Links(80, 0.66, 28)
#: Ids that may be sent to all tasks (8 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 200_000

_RNG = np.random.default_rng(5)
_MUL = _RNG.integers(1, 2**63, size=THIN.trees * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, size=THIN.trees * DEPTH, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MORE = (STAGE.trees - THIN.trees) * DEPTH  # drawn last: the first trees are the same in both
_MUL = np.append(_MUL, _RNG.integers(1, 2**63, size=_MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_ADD = np.append(_ADD, _RNG.integers(0, 2**63, size=_MORE, dtype=np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _WordHash(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHash()


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=n)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], dtype=np.uint64)
        m = n - SHINGLE + 1
        s = h[:m] * _PLACE[0]
        for k in range(1, SHINGLE):
            s += h[k:k + m] * _PLACE[k]
        s = np.sort(_mix(s))
    return s[np.r_[True, s[1:] != s[:-1]]]


def signature(s: np.ndarray, trees: int = THIN.trees) -> bytes:
    """trees x DEPTH MinHash values of 16 bits, big-endian, so that bytes sort as
    the values do."""
    mul, add = _MUL[:trees * DEPTH, None], _ADD[:trees * DEPTH, None]
    low = np.full(trees * DEPTH, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 2048):
            part = s[k:k + 2048]
            np.minimum(low, (mul * part + add).min(axis=1), out=low)
        return (_mix(low) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _sign(batches, links: Links):
    for pdf in batches:
        n, k1, k2, sig = [], [], [], []
        for text in pdf["text"]:
            s = shingle_set(text)
            a, b = set_key(s)
            n.append(len(s))
            k1.append(a)
            k2.append(b)
            sig.append(signature(s, links.trees) if len(s) else b"")
        yield pd.DataFrame({"id": pdf["id"], "n": n, "k1": k1, "k2": k2, "sig": sig})


def _entries(batches, links: Links):
    """The class's place in every tree: its first MIN_DEPTH values and the rest."""
    for pdf in batches:
        if not len(pdf):
            continue
        v = np.frombuffer(b"".join(pdf["sig"]), dtype=">u8").astype(np.int64).reshape(len(pdf), links.trees, DEPTH // 4)
        yield pd.DataFrame({"cid": np.repeat(pdf["cid"].to_numpy(), links.trees),
                            "tree": np.tile(np.arange(links.trees, dtype=np.int32), len(pdf)),
                            "hi": v[:, :, 0].ravel(), "lo": v[:, :, 1].ravel()})


def _by_region(batches):
    """(frame) per region, from rows sorted by region."""
    held = None
    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        r = pdf["region"].to_numpy()
        cut = np.flatnonzero(r[1:] != r[:-1]) + 1
        for a, b in zip(np.r_[0, cut[:-1]] if len(cut) else [], cut, strict=True):
            yield pdf.iloc[a:b]
        held = pdf.iloc[cut[-1] if len(cut) else 0:]
    if held is not None and len(held):
        yield held


def likely_pairs(sig: np.ndarray, n: np.ndarray, links: Links = THIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, estimate) of the pairs a < b that may be similar enough."""
    out = []
    for i in range(len(sig) - 1):
        same = (sig[i + 1:] == sig[i]).sum(axis=1) / sig.shape[1]
        size = n[i + 1:]
        ok = (same >= links.likely) & (100 * np.minimum(size, n[i]) >= links.percent * np.maximum(size, n[i]))
        j = np.flatnonzero(ok)
        if len(j):
            out.append((np.full(len(j), i), j + i + 1, same[j]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(n: int, a, b, est) -> list[int]:
    """Indices of a spanning forest of the pairs, the most similar first."""
    f = list(range(n))

    def root(x):
        while f[x] != x:
            f[x] = f[f[x]]
            x = f[x]
        return x

    kept = []
    for k in np.lexsort((b, a, -est)):
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            f[max(x, y)] = min(x, y)
            kept.append(int(k))
    return kept


def _first_pairs(batches, links: Links):
    """Spanning forest of each region's likely pairs."""
    out, size = [], 0
    for g in _by_region(batches):
        if len(g) < 2:
            continue
        g = g.sort_values("cid")
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint16).reshape(len(g), -1)
        a, b, est = likely_pairs(sig, g["n"].to_numpy(), links)
        keep = _forest(len(g), a, b, est)
        if keep:
            cid = g["cid"].to_numpy()
            out.append(pd.DataFrame({"a": cid[a[keep]], "b": cid[b[keep]]}))
            size += len(keep)
        if size > 100_000:
            yield pd.concat(out)
            out, size = [], 0
    if out:
        yield pd.concat(out)


def _unsettled(batches, links: Links):
    """(region, cid, comp) of the members in a likely pair between components."""
    for g in _by_region(batches):
        if len(g) < 2:
            continue
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint16).reshape(len(g), -1)
        a, b, _ = likely_pairs(sig, g["n"].to_numpy(), links)
        comp = g["comp"].to_numpy()
        apart = comp[a] != comp[b]
        at = np.unique(np.concatenate([a[apart], b[apart]]))
        if len(at):
            yield g.iloc[at][["region", "cid", "comp"]]


def _settle(batches, links: Links):
    """Spanning forest of the links between components, from the full sets of a
    region's members."""
    for g in _by_region(batches):
        sets = [np.frombuffer(x, np.uint64) for x in g["s"]]
        n = np.array([len(x) for x in sets])
        both = common_counts(sets)
        cid, comp = g["cid"].to_numpy(), g["comp"].to_numpy()
        a, b = np.nonzero(np.triu(100 * both >= links.percent * (n[:, None] + n[None, :] - both), 1) & (comp[:, None] != comp[None, :]))
        if len(a):
            names, at = np.unique(comp, return_inverse=True)
            keep = _forest(len(names), at[a], at[b], np.zeros(len(a)))
            yield pd.DataFrame({"a": cid[a[keep]], "b": cid[b[keep]]})


def common_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    both = np.zeros((len(sets), len(sets)), dtype=np.int64)
    if not len(owner):
        return both
    values, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(held > 1) - 1  # a shingle of one set adds nothing to a pair
    use = held[at] > 1
    owner, at = owner[use], shared[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, total, columns):
        i, j = np.searchsorted(at, [lo, lo + columns])
        m = np.zeros((len(sets), min(columns, total - lo)), dtype=np.float32)
        m[owner[i:j], at[i:j] - lo] = 1
        both += (m @ m.T).astype(np.int64)
    np.fill_diagonal(both, [len(x) for x in sets])
    return both


def _sets(batches):
    for pdf in batches:
        s = [shingle_set(t) for t in pdf["text"]]
        yield pd.DataFrame({"cid": [set_key(x)[0] for x in s], "s": [x.tobytes() for x in s]})


def _confirm(batches, links: Links):
    for pdf in batches:
        ok = []
        for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            ok.append(100 * both >= links.percent * (len(x) + len(y) - both))
        yield pdf.loc[ok, ["a", "b"]]


def _confirmed(pairs: DataFrame, sets: DataFrame, links: Links) -> DataFrame:
    a = sets.select(F.col("cid").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("cid").alias("b"), F.col("s").alias("sb"))
    return pairs.distinct().join(a, "a").join(b, "b").mapInPandas(partial(_confirm, links=links), "a long, b long")


def regions(classes: DataFrame, scratch: C.Scratch, links: Links = THIN) -> tuple[DataFrame, DataFrame | None]:
    """(region, cid): the forest's regions, each at most about REGION classes; and
    (crowd, cid) of the classes that share all values of a tree with more."""
    entries = classes.select("cid", "sig").mapInPandas(partial(_entries, links=links), "cid long, tree int, hi long, lo long")
    entries = scratch.cut(entries, "entries")
    found, crowd, depth = [], None, MIN_DEPTH
    while True:
        prefix = F.lit(0).cast("long") if depth == MIN_DEPTH else F.shiftrightunsigned("lo", 16 * (DEPTH - depth))
        here = entries.withColumn("p", prefix)
        held = here.groupBy("tree", "hi", "p").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        here = here.join(held, ["tree", "hi", "p"])
        here = scratch.cut(here.withColumn("region", F.xxhash64(F.lit(depth), "tree", "hi", "p")), f"depth{depth}")
        found.append(here.where(F.col("held") <= REGION).select("region", "cid"))
        full = here.where(F.col("held") > REGION)
        if not full.limit(1).count():
            break
        if depth == DEPTH:
            block = F.pmod(F.xxhash64("cid"), F.ceil(F.col("held") / (REGION // 2)).cast("long"))
            crowd = full.select(F.col("region").alias("crowd"), "cid")
            found.append(full.select(F.xxhash64("region", block).alias("region"), "cid"))
            break
        entries, depth = full.select("cid", "tree", "hi", "lo"), depth + 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    # One of the regions with the same members, by two sums of the members' hashes.
    sums = out.groupBy("region").agg(F.count(F.lit(1)).alias("held"), F.bit_xor("cid").alias("x"),
                                     F.bit_xor(F.xxhash64("cid")).alias("y")).where("held > 1")
    one = sums.groupBy("held", "x", "y").agg(F.min("region").alias("region")).select("region")
    return scratch.cut(out.join(one, "region"), "regions"), crowd


def _crowd_hubs(crowd: DataFrame) -> DataFrame:
    hubs = crowd.groupBy("crowd").agg(F.min("cid").alias("a"))
    return crowd.join(hubs, "crowd").where("a < cid").select("a", F.col("cid").alias("b"))


def _crowd_regions(crowd: DataFrame, comp: DataFrame) -> DataFrame:
    """(region, cid): in a crowd every block of members outside the main component
    together with every block of all members, half a region each."""
    half = REGION // 2
    of = crowd.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    per = of.groupBy("crowd", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("crowd").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("top"))
    per = (per.where(F.col("all") > F.col("top")).select(
        "crowd", "main", F.ceil(F.col("all") / half).cast("long").alias("blocks"),
        F.ceil((F.col("all") - F.col("top")) / half).cast("long").alias("apart")))
    of = of.join(per, "crowd")
    h = F.xxhash64(F.lit(7), "cid")
    every = of.withColumn("j", F.pmod(h, "blocks")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("apart") - 1)))
    some = (of.where("comp <> main").withColumn("i", F.pmod(h, "apart"))
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    region = F.xxhash64("crowd", "i", "j").alias("region")
    return every.select(region, "cid").unionByName(some.select(region, "cid")).distinct()


def near_duplicates(docs: DataFrame, scratch: C.Scratch, links: Links = THIN) -> DataFrame:
    """``docs`` is (id long, text); returns one row per row: id, n_shingles,
    component_id, the smallest id that is linked, directly or over others; a pair is
    linked from ``links.percent`` on."""
    spark = docs.sparkSession
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")
    signed = docs.select(C.as_text("id"), "text").mapInPandas(partial(_sign, links=links), "id string, n long, k1 long, k2 long, sig binary")
    signed = scratch.cut(signed.withColumn("id", F.col("id").cast("long")), "signed")
    classes = (signed.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2")
               .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    classes = scratch.cut(classes.withColumnRenamed("k1", "cid"), "classes")
    region, crowd = regions(classes, scratch, links)
    members = scratch.cut(region.join(classes.select("cid", "n", "sig"), "cid"), "members")
    scratch.drop("entries", "regions")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = members.repartition(width, "region").sortWithinPartitions("region").mapInPandas(partial(_first_pairs, links=links), "a long, b long")
    if crowd is not None:
        first = first.unionByName(_crowd_hubs(crowd))
    first = scratch.cut(first, "first")

    # Shingle sets of the classes in a likely pair, from their texts.
    asked = first.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    asked = scratch.cut(asked.join(classes.select("cid", "rep"), "cid").select(F.col("rep").alias("id")), "asked")
    few = asked.count() <= BROADCAST_IDS
    sets = docs.join(F.broadcast(asked) if few else asked, "id").mapInPandas(_sets, "cid long, s binary")
    sets = scratch.cut(sets, "sets")
    comp = C.components(scratch.cut(_confirmed(first, sets, links), "links1"), scratch, "cc1")

    member = members.select("region", "cid")
    if crowd is not None:
        member = member.unionByName(_crowd_regions(crowd, comp))
    labelled = member.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    split = labelled.groupBy("region").agg((F.min("comp") < F.max("comp")).alias("split")).where("split").select("region")
    labelled = labelled.join(split, "region").select("region", "cid", "comp").join(classes.select("cid", "n", "sig"), "cid")
    unsettled = scratch.cut(labelled.repartition(width, "region").sortWithinPartitions("region").mapInPandas(
        partial(_unsettled, links=links), "region long, cid long, comp long"), "unsettled")
    more = (unsettled.join(sets, "cid").repartition(width, "region").sortWithinPartitions("region")
            .mapInPandas(partial(_settle, links=links), "a long, b long"))
    more = scratch.cut(more, "links2")
    scratch.drop("members", "sets", "first", "unsettled", *[f"depth{d}" for d in range(MIN_DEPTH, DEPTH + 1)])
    if more.limit(1).count():
        # What was connected, as stars, and the links between.
        comp = C.components(more.unionByName(comp.select(F.col("component").alias("a"), F.col("node").alias("b"))), scratch, "cc2")
    per_class = (classes.select("cid", "k2", "rep").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                 .withColumn("component", F.coalesce("component", "cid")))
    smallest = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = per_class.join(smallest, "component").select(F.col("cid").alias("k1"), "k2", "component_id")
    some = (F.col("n") > 0) & F.col("id").isNotNull()
    alone = signed.where(~some).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return (signed.where(some).drop("sig").join(per_class, ["k1", "k2"])
            .select("id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone))


def drop_near_duplicates(docs: DataFrame, links: Links = STAGE) -> DataFrame:
    """One document of each component: that of the smallest doc_id."""
    scratch = C.Scratch(docs.sparkSession, "minhash")
    keyed = C.numbered(docs, scratch)
    groups = near_duplicates(keyed.select(F.col("_m").alias("id"), "_doc.text"), scratch, links)
    first = (groups.select(F.col("id").alias("_m"), F.col("component_id").alias("_c")).join(keyed.select("_m", "_doc.doc_id"), "_m")
             .groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_m")).alias("k")))
    keep = scratch.cut(first.select(F.col("k._m").alias("_m")), "keep")
    scratch.keep_only("numbered", "keep")
    return keyed.join(keep, "_m").select("_doc.*")


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = near_duplicates(docs, C.Scratch(spark, "minhash"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
