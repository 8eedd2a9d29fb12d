"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of rising doc_id.  A batch's distinct line hashes are
merge-joined with every run (what is found there was first held by an earlier
batch), its unseen hashes become a new run, and ``fanout`` runs of one level are
merged into one run of the next.  Runs are bucketed tables, sorted by hash in
each bucket, so neither the look-up nor the compaction shuffles what is stored;
only the batch moves.

Hashes are 128 bits.  A line that a third of all documents share is one row per
map task after partial aggregation; where documents look up their duplicated
lines, both sides are plain shuffles that adaptive execution splits on skew.

Defined results: null or empty text is one empty line; a null doc_id sorts after
all others; rows of one doc_id are one document when holders are counted, and
each row gets its own result; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C

MIN_CHARS = 10
N_BATCHES = 4
FANOUT = 2
_LAST = 2**63 - 1


def _keys(text: str) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys, as UTF-8."""
    data = text.encode("utf-8", "surrogatepass")
    # bytes.lower and bytes.strip touch A-Z and ASCII white space only.
    return data.split(b"\n"), [k.strip() for k in data.lower().split(b"\n")]


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _halves(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _hash_lines(batches, min_chars: int):
    for pdf in batches:
        ids, h1, h2 = [], [], []
        for doc, text in zip(pdf["_d"].tolist(), pdf["text"], strict=True):
            for key in {k for k in _keys(text)[1] if _counts(k, min_chars)} if text else ():
                a, b = _halves(key)
                ids.append(doc)
                h1.append(a)
                h2.append(b)
        yield pd.DataFrame({"_d": ids, "h1": h1, "h2": h2}, dtype="int64")


def _digest(batches, min_chars: int):
    for pdf in batches:
        n, gone, sha = [], [], []
        for text, drop in zip(pdf["text"], pdf["drop"], strict=True):
            text = text or ""
            if drop is None or not len(drop):
                n.append(text.count("\n") + 1)
                gone.append(0)
                sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                continue
            lines, keys = _keys(text)
            drop = set(map(int, drop))
            kept = [x for x, k in zip(lines, keys, strict=True) if not (_counts(k, min_chars) and _halves(k)[0] in drop)]
            n.append(len(lines))
            gone.append(len(lines) - len(kept))
            sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_lines": n, "n_dropped": gone, "kept_sha256": sha})


def _kept_text(text: str | None, drop, min_chars: int) -> str | None:
    if not text or drop is None or not len(drop):
        return text
    lines, keys = _keys(text)
    drop = set(map(int, drop))
    kept = [x for x, k in zip(lines, keys, strict=True) if not (_counts(k, min_chars) and _halves(k)[0] in drop)]
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


class LineRuns:
    """The levelled runs: bucketed tables of the line hashes seen so far.

    A context: inside it the session lets a scan of one file a bucket count as sorted;
    at its end, also by an error, the runs are removed.
    """

    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark, scratch: C.Scratch, fanout: int = FANOUT):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # (level, table), oldest first

    def __enter__(self) -> LineRuns:
        self.before = self.spark.conf.get(self.ORDERED, "false")
        self.spark.conf.set(self.ORDERED, "true")
        return self

    def __exit__(self, *error) -> None:
        self.spark.conf.set(self.ORDERED, self.before)
        for _, name in self.runs:
            self._forget(name)
        self.runs = []

    def _store(self, keys: DataFrame) -> str:
        """Write ``keys``, which come in one partition a bucket, as a run."""
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", self.scratch.path(name)).saveAsTable(name))
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, ...) with ``known``: an earlier batch has the line."""
        known = F.lit(False)
        for i, (_, name) in enumerate(self.runs):
            run = self.spark.table(name).withColumn(f"_in{i}", F.lit(True))
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left")
            known = known | F.coalesce(F.col(f"_in{i}"), F.lit(False))
        return keys.withColumn("known", known).drop(*[f"_in{i}" for i in range(len(self.runs))])

    def merged(self, older: str, newer: str) -> DataFrame:
        """Two runs as one: a merge join of their buckets.  A hash is in one run only,
        so the join pairs nothing and gives the rows of both, one task a bucket."""
        return self.spark.table(older).hint("merge").join(self.spark.table(newer), ["h1", "h2"], "full")

    def add(self, keys: DataFrame) -> None:
        """Add a batch's unseen hashes as a run; merge full levels, two runs at a time."""
        self.runs.append((0, self._store(keys.repartition(self.buckets, "h1", "h2"))))
        while len(self.runs) >= self.fanout and len({lv for lv, _ in self.runs[-self.fanout:]}) == 1:
            level = self.runs[-1][0]
            for _ in range(self.fanout - 1):
                (_, older), (_, newer) = self.runs[-2:]
                self.runs[-2:] = [(level, self._store(self.merged(older, newer)))]
                self._forget(older)
                self._forget(newer)
            self.runs[-1] = (level + 1, self.runs[-1][1])


def dropped_lines(docs: DataFrame, scratch: C.Scratch, n_batches: int = N_BATCHES, min_chars: int = MIN_CHARS,
                  fanout: int = FANOUT) -> DataFrame:
    """(_d, drop): per document key the first hash halves of the lines that it
    loses; at most one entry per line of the document."""
    spark = docs.sparkSession
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_d")
    cuts = docs.select(d).approxQuantile("_d", [k / n_batches for k in range(1, n_batches)], 0.01) if n_batches > 1 else []
    batch = sum(((F.col("_d") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    lines = (docs.select(d, "text").mapInPandas(lambda it: _hash_lines(it, min_chars), "_d long, h1 long, h2 long")
             .withColumn("batch", batch))
    lines.write.partitionBy("batch").parquet(scratch.path("lines"))
    schema = C.struct_of("_d long, h1 long, h2 long, batch int")
    lines = spark.read.schema(schema).parquet(scratch.path("lines"))
    found = []
    with LineRuns(spark, scratch, fanout) as runs:
        for b in range(len(cuts) + 1):
            mine = lines.where(F.col("batch") == b).select("_d", "h1", "h2")
            keys = mine.groupBy("h1", "h2").agg(F.min("_d").alias("first"), F.max("_d").alias("last"))
            keys = scratch.cut(runs.look_up(keys), f"keys{b}")
            if b < len(cuts):
                runs.add(keys.where(~F.col("known")).select("h1", "h2"))
            many = keys.where("known OR last > first")
            lost = mine.join(many, ["h1", "h2"]).where("known OR _d > first").select("_d", "h1")
            found.append(scratch.cut(lost, f"lost{b}"))
            scratch.drop(f"keys{b}")
    scratch.drop("lines")
    lost = found[0]
    for x in found[1:]:
        lost = lost.unionByName(x)
    return lost.groupBy("_d").agg(F.collect_set("h1").alias("drop"))


def _with_drops(docs: DataFrame, drops: DataFrame, *columns) -> DataFrame:
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(d.alias("_d"), "text", *columns).join(drops.hint("shuffle_hash"), "_d", "left").drop("_d")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """The documents without the lines that a smaller doc_id holds."""
    @F.pandas_udf("string")
    def kept(text: pd.Series, drop: pd.Series) -> pd.Series:
        return pd.Series([_kept_text(t, d, min_chars) for t, d in zip(text, drop, strict=True)], dtype=object)

    scratch = C.Scratch(docs.sparkSession, "lines")
    drops = dropped_lines(docs, scratch, min_chars=min_chars, **options)
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    out = _with_drops(docs, drops, doc)
    return out.select(F.col("_doc").withField("text", kept("text", "drop")).alias("_doc")).select("_doc.*")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    drops = dropped_lines(docs, C.Scratch(spark, "lines"))
    digests = _with_drops(docs, drops, C.as_text("doc_id")).mapInPandas(
        lambda it: _digest(it, MIN_CHARS), "doc_id string, n_lines long, n_dropped long, kept_sha256 string")
    return digests.withColumn("doc_id", F.col("doc_id").cast("long"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM l),
o AS (SELECT line_key, min(doc_id) AS owner FROM k WHERE length(line_key) >= 10 GROUP BY line_key),
d AS (SELECT k.*, coalesce(doc_id > owner, false) AS dropped FROM k LEFT JOIN o USING (line_key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
