"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; a row's
fractional rank is (rank + phase of the source) / rows of the source.  Sorted by
fractional rank, any run of consecutive rows holds every source in proportion,
so equal cuts of that order give shards that match the mixture, with row counts
at most one apart (law ``rows``).

DataFrame functions only.  Neither a source nor the whole order is ever sorted
in one task: both are split into parts of the hash or of the fractional rank,
and the parts' counts give the offsets.

Defined results: a null source is a stratum of its own; null text counts no
bytes; repeated rows are rows like any other (which of two equal rows gets which
slot cannot be told apart); an empty table gives an empty result; other columns
are passed through, but for columns named shard or slot, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C

SEED = 20_261


def interleave(rows: DataFrame, stratum: Column, identity: list[Column], n_shards: int, scratch: C.Scratch,
               seed: int = SEED) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``identity`` are columns of the content; they seed the shuffle.  Rows with
    the same content may swap places.  ``rows`` should be slim: it is shuffled
    twice.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    slim = rows.select(kept.alias("_row"), stratum.alias("_s"), F.xxhash64(F.lit(seed), *identity).alias("_h"))
    slim = scratch.cut(slim, "shuffled")
    n = slim.count()
    if not n:
        return slim.select("_row.*", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    parts = C.parts_for(n)
    ties = ["_h", "_row"]
    ranked = C.running(slim.withColumn("_p", F.floor(C.unit(F.col("_h")) * parts)), "_s", "_p", ties, None, "_r", "_n")
    phase = C.unit(F.xxhash64(F.lit(seed + 1), F.col("_s")))
    ranked = scratch.cut(ranked.select("_row", "_h", "_s", ((F.col("_r") + phase) / F.col("_n")).alias("_x")), "ranked")
    scratch.drop("shuffled")
    placed = C.running(ranked.withColumn("_p", F.floor(F.col("_x") * parts)), None, "_p", ["_x", "_s", *ties], None,
                       "_i", "_all")
    shard = F.expr(f"(_i * {n_shards}L) div {n}L")
    first = F.expr(f"(_shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn("_shard", shard)
    return placed.select("_row.*", F.col("_shard").cast("int").alias("shard"), (F.col("_i") - first).alias("slot"))


def shard_index(docs: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes + 8), text_crc32, source, law, shard, slot."""
    scratch = C.Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    ident = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    out = interleave(slim, C.group_key("source"), ident, n_shards, scratch, seed)
    return out.withColumn("law", F.lit("rows"))


def shard_documents(docs: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """All columns of the documents with ``shard`` and ``slot``.

    The rows are written once under a generated number; only numbers and content
    hashes are placed, and the place is joined back, so texts move once.
    """
    scratch = C.Scratch(docs.sparkSession, "sharding")
    docs = docs.drop("shard", "slot")
    keyed = C.numbered(docs, scratch, _k=F.xxhash64("doc_id", "text"), _src=C.group_key("source"))
    out = interleave(keyed.select("_k", "_m", "_src"), F.col("_src"), [F.col("_k")], n_shards, scratch, seed)
    return keyed.select("_doc", "_m").join(out.select("_m", "shard", "slot"), "_m").select("_doc.*", "shard", "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_index(C.table(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")
