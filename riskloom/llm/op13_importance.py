"""Target-distribution importance resampling over hashed n-grams.

Separators of a lower-cased text collapse to single blanks.  One overlapped scan
with boundary lookarounds then stops at every word start and gives the spans of
the runs of one to three words that begin there; the CRC-32 of a span modulo the
number of buckets is its feature.  A first pass over the corpus keeps each
document's buckets as packed numbers; corpus and target counts are sums of
per-task bucket counts, at most ``n_buckets`` rows a task.  A bucket's gain is the
floored log ratio of its smoothed shares in target and corpus, a document's weight
the sum over its features, and its score the weight plus Gumbel noise from a hash
of its id.  The best share of the documents of at least ``min_words`` words is
drawn: ranks are counted in range partitions of (score, id) and offset by the
partitions' sizes, so no task holds the whole order.

Only the ``n_buckets`` gains go to the driver and to the tasks.

Defined results: null, empty or wordless text has no features, weight 0 and no
rank; a null doc_id hashes as ``42:`` and ties after all others; repeated rows are
documents of their own with equal scores, in any order among themselves; texts of
any length are scanned whole, their features held as packed numbers; an empty
corpus gives an empty result, an empty target equal counts of 0; other columns are
carried by ``resample`` whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C

N_BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42

#: Everything that is no digit, lower-case letter or non-ASCII character; on UTF-8.
SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: At every word start the runs of three, two and one words, as far as there are so many.
RUNS = regex.compile(rb"(?<![^ ])(?=((([^ ]++)(?: [^ ]++)?+)(?: [^ ]++)?+))")


def collapse(text: str | None) -> bytes:
    """The words of a text, lower-cased, with single blanks between them."""
    return SEPARATORS.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ")


def _hashes(words: bytes):
    for m in RUNS.finditer(words, overlapped=True):
        three, two, one = m.group(1, 2, 3)
        yield zlib.crc32(one)
        if len(two) > len(one):
            yield zlib.crc32(two)
            if len(three) > len(two):
                yield zlib.crc32(three)


def text_buckets(text: str | None, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """The bucket of every feature of a text, repeats included."""
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"
    return (np.fromiter(_hashes(collapse(text)), dtype=np.uint32) % np.uint32(n_buckets)).astype(kind)


def scan(texts: DataFrame, scratch: C.Scratch, table: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``texts`` (text, other columns), written with n_words, n_features and the
    packed ``buckets`` in place of the text."""
    others = [c for c in texts.columns if c != "text"]

    def scanned(batches):
        for batch in batches:
            words, size, packed = [], [], []
            for text in batch.column("text"):
                b = text_buckets(text.as_py(), n_buckets)
                # n words have 3 n - 3 runs of up to three words, from two words on
                words.append((len(b) + 3) // 3 if len(b) > 1 else len(b))
                size.append(len(b))
                packed.append(b.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(words, pa.int64()), pa.array(size, pa.int64()), pa.array(packed, pa.binary())],
                names=[*others, "n_words", "n_features", "buckets"])

    kept = C.struct_of("n_words long, n_features long, buckets binary")
    schema = type(kept)([texts.schema[c] for c in others] + kept.fields)
    return scratch.cut(texts.select(*others, "text").mapInArrow(scanned, schema), table)


def bucket_counts(scanned: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs; summed in the tasks first."""
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def counted(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return scanned.select("buckets").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 * ln of its smoothed share in the target over that in
    the corpus), from (bucket, n) tables of at most ``n_buckets`` rows."""
    s, t = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.collect():  # at most n_buckets rows
            into[r["bucket"]] = r["n"]
    big_s, big_t = float(s.sum() + n_buckets), float(t.sum() + n_buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * big_s / ((float(a) + 1) * big_t)))
                     for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def weighed(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """``weight``, the sum of the gains of a document's features, in place of the
    buckets."""
    others = [c for c in scanned.columns if c != "buckets"]
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def summed(batches):
        for batch in batches:
            total = [int(gain[np.frombuffer(p.as_py(), kind)].sum()) for p in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(total, pa.int64())], names=[*others, "weight"])

    schema = type(scanned.schema)([scanned.schema[c] for c in others] + C.struct_of("weight long").fields)
    return scanned.mapInArrow(summed, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, scratch: C.Scratch, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` (doc_id, _m, n_words, score, ...) with ``rank``: 1, 2, 3... for the
    best ``percent`` of the documents of at least ``min_words`` words, else null."""
    scored = scratch.cut(scored, "scored")
    long_enough = F.col("n_words") >= min_words
    n = scored.where(long_enough).count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_m")]
    ranges = (scored.where(long_enough).repartitionByRange(C.parts_for(n), *order)
              .withColumn("_part", F.spark_partition_id()))
    placed = C.running(scratch.cut(ranges, "ranges"), None, "_part", order, None, "_before", "_all")
    rank = F.when(F.col("_before") < F.lit(percent * n // 100), F.col("_before") + 1).cast("long")
    return (placed.withColumn("rank", rank).drop("_part", "_before", "_all")
            .unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))))


def scored_documents(docs: DataFrame, target: DataFrame, scratch: C.Scratch, seed: int = SEED, n_buckets: int = N_BUCKETS) -> DataFrame:
    """doc_id, _m, n_words, n_features, weight, score of ``docs`` (doc_id, _m, text)."""
    corpus = scan(docs.select("doc_id", "_m", "text"), scratch, "corpus", n_buckets)
    wanted = scan(target.select("text"), scratch, "target", n_buckets)
    gain = gains(bucket_counts(corpus, n_buckets), bucket_counts(wanted, n_buckets), n_buckets)
    return weighed(corpus, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             n_buckets: int = N_BUCKETS) -> DataFrame:
    """The drawn documents, in all their columns: those most like ``target`` (text)
    by weight and noise."""
    scratch = C.Scratch(docs.sparkSession, "importance")
    rows = C.numbered(docs, scratch)
    inner = rows.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "_m", F.col("_doc.text").alias("text"))
    drawn = ranked(scored_documents(inner, target, scratch, seed, n_buckets), scratch, percent, min_words).where("rank IS NOT NULL")
    return rows.join(drawn.select("_m"), "_m", "left_semi").select("_doc.*")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "importance")
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("_m"), "text")
    out = ranked(scored_documents(docs, C.table(spark, sf_dir, "benchmark"), scratch), scratch)
    scratch.drop("corpus", "target")
    return out.select("doc_id", "n_features", "weight", "score", "rank")
