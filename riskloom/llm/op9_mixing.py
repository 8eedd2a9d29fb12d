"""Mixing sources to target weights by blocks.

The words of each source, its documents in a seeded order, form one stream that
is cut into blocks of fixed length.  A source takes as many slots as its target
needs; for each source the slots per output shard are one multinomial draw (equal
shares), so over the sources every output shard gets multinomial counts that
add up to the targets.  Slot j of a source maps through a pseudorandom
permutation of the source's blocks (a Feistel network with cycle walking, one
key for each pass over the source), and the slots join the blocks by index.

A source's target is its weight's share of all words, at most ``max_repeat``
times its own words, what is over being shared anew among the others.  The last
slot takes only the words still missing, so totals meet targets to a word.  A
block is taken at most ceil(target / source) times, hence no document more than
``max_repeat`` times.

Defined results: null text has no words; documents without words are never
taken and have taken 0; a null source is a source of its own, last in order; if
no document has words every target is 0; repeated rows are documents of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C
from riskloom.operators.windows import global_rank

SEED = 90_210
BLOCK_WORDS = 256
MAX_REPEAT = 3
WEIGHTS = (5, 2, 1)
N_SHARDS = 24
#: Slots that one task draws at a time; larger draws are split.
SLOT_CHUNK = 100_000


def word_count(text) -> F.Column:
    """Number of words, by the white space between them."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(_s, source_size, weight, target) per source from (_s, source_size).

    ``_s`` sorts by code point with the null source last.  ``sizes`` is read by every
    round, so it should be a written table of one row a source; sources are numbered by
    ranges, as they may be many.  The share of the open sources is settled by rounds
    that each read two sums, until no further source is over its cap.
    """
    last = F.col("_s") == "0"
    sizes = global_rank(sizes.withColumn("_last", last), [F.asc("_last"), F.asc("_s")], "_n").drop("_last")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        over = F.col("cap") < F.col("weight") * level
        capped, open_w, n_open = t.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
                                       F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
                                       F.sum(F.when(over, 0).otherwise(1))).first()
        nxt = (total - capped) / open_w if n_open else level
        if nxt <= level:
            break
        level = nxt
    return t.select("_s", "source_size", "weight", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(n[k]) at i[k], elementwise: a 4-round
    balanced Feistel network on the next even number of bits, walked until the
    value falls below n."""
    i, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(float), 2.0)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.arange(len(i))
    with np.errstate(over="ignore"):
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                f = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _multinomial(batches, n_shards: int, seed: int):
    """Per source: how many slots each output shard takes, and the number of
    the first, split into chunks."""
    for pdf in batches:
        rows = []
        for s, h, n in zip(pdf["_s"], pdf["_h"], pdf["n_slots"], strict=True):
            rng = np.random.default_rng([seed, int(h) & 0xFFFFFFFF, (int(h) >> 32) & 0xFFFFFFFF])
            start = 0
            for shard, c in enumerate(rng.multinomial(int(n), [1.0 / n_shards] * n_shards).tolist()):
                rows += [(s, shard, start + a, min(SLOT_CHUNK, c - a)) for a in range(0, c, SLOT_CHUNK)]
                start += c
        yield pd.DataFrame(rows, columns=["_s", "shard", "first", "n"]).astype({"shard": "int32", "first": "int64", "n": "int64"})


def _slots(batches):
    """One row per slot with the block that it takes."""
    for pdf in batches:
        for lo in range(0, len(pdf), 64):
            p = pdf.iloc[lo:lo + 64]
            rep = np.repeat(np.arange(len(p)), p["n"].to_numpy())
            j = p["first"].to_numpy()[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(p["n"].to_numpy()) - p["n"].to_numpy(), p["n"].to_numpy())
            n = p["n_blocks"].to_numpy()[rep]
            key = p["_h"].to_numpy()[rep].astype(np.uint64) + (j // n).astype(np.uint64)
            yield pd.DataFrame({"_s": p["_s"].to_numpy()[rep], "shard": p["shard"].to_numpy()[rep], "j": j,
                                "block": _permute(j % n, n, key)})


class Mix:
    """What :func:`mix` returns.

    documents: all columns of the input slim rows, source_size, target, taken and
    shares, an array of (shard, words) by shard: the words that each output shard takes.
    slots: (_s, shard, j, block, words): the blocks of every output shard.
    pieces: (_id, block, lo, hi, taken): the words [lo, hi) of a document
    that lie in a block, and how often the mix takes its first words.
    """

    def __init__(self, documents, slots, pieces):
        self.documents, self.slots, self.pieces = documents, slots, pieces


def mix(sized: DataFrame, scratch: C.Scratch, weights=WEIGHTS, max_repeat: int = MAX_REPEAT,
        block_words: int = BLOCK_WORDS, n_shards: int = N_SHARDS, seed: int = SEED) -> Mix:
    """Mix ``sized`` rows: _id (a unique long), _k (a hash of the content, which
    orders the source), _s (see ``group_key``), size (words).

    The rows are written first, so ``_id`` may be a generated number.  Rows of
    equal content may swap places between reruns, which no result shows.
    """
    sized = scratch.cut(sized.withColumn("_h", F.xxhash64(F.lit(seed), "_k")), "sized")
    n = sized.count()
    sources = scratch.cut(sized.groupBy("_s").agg(F.sum("size").alias("source_size")), "sums")
    sources = source_targets(sources, weights, max_repeat)
    # Whole words: rounded down to what the source can give.
    sources = (sources.withColumn("words", F.least(F.round("target"), F.col("source_size") * max_repeat).cast("long"))
               .withColumn("n_blocks", F.expr(f"(source_size + {block_words - 1}L) div {block_words}L"))
               .withColumn("_h", F.xxhash64(F.lit(seed + 1), "_s")))
    # Whole passes over the source need no draw beyond their n_blocks slots; the rest is drawn from one more pass.
    sources = (sources.withColumn("passes", F.expr("if(source_size > 0, words div source_size, 0L)"))
               .withColumn("rest", F.expr("words - passes * source_size"))
               .withColumn("n_slots", F.expr(f"passes * n_blocks + least(n_blocks, (rest + {block_words - 1}L) div {block_words}L + if(rest > 0, 1L, 0L))")))
    sources = scratch.cut(sources, "sources")

    part = F.floor(C.unit(F.col("_h")) * C.parts_for(n))
    stream = C.running(sized.withColumn("_p", part), "_s", "_p", ["_h", "_k", "_id"], "size", "_start", "_all")
    b = f"{block_words}L"
    pieces = (stream.where("size > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(_start div {b}, (_start + size - 1) div {b})")))
              .withColumn("at", F.expr(f"greatest(_start, block * {b})"))
              .select("_id", "_s", "block", F.expr(f"at - block * {b}").alias("in_block"),
                      F.expr("at - _start").alias("lo"),
                      F.expr(f"least(_start + size, (block + 1) * {b}) - _start").alias("hi")))
    pieces = scratch.cut(pieces, "pieces")

    draws = (sources.where("n_slots > 0").select("_s", "_h", "n_slots")
             .mapInPandas(lambda it: _multinomial(it, n_shards, seed), "_s string, shard int, first long, n long"))
    slots = (draws.join(sources.select("_s", "_h", "n_blocks"), "_s").repartition(F.col("_s"), F.col("shard"), F.col("first"))
             .mapInPandas(_slots, "_s string, shard int, j long, block long"))
    slots = slots.join(sources.select("_s", "n_blocks", "passes", "rest", "source_size"), "_s")
    length = F.expr(f"if(block = n_blocks - 1, source_size - block * {b}, {b})")
    slots = slots.withColumn("length", length).withColumn("pass", F.expr("j div n_blocks"))
    # The slots of the last, partial pass take words until the target is met: a
    # running sum of block lengths, where only the block with the short end differs.
    short = (slots.where(f"pass = passes AND block = n_blocks - 1 AND length < {b}")
             .select("_s", F.col("j").alias("short_j"), (F.lit(block_words) - F.col("length")).alias("lack")))
    slots = slots.join(short, "_s", "left")
    before = F.expr(f"(j - passes * n_blocks) * {b} - if(short_j < j, lack, 0L)")
    words = F.when(F.col("pass") < F.col("passes"), F.col("length")).otherwise(
        F.greatest(F.lit(0), F.least(F.col("length"), F.col("rest") - before)))
    slots = scratch.cut(slots.select("_s", "shard", "j", "block", words.alias("words")).where("words > 0"), "slots")

    # The slots of each block, at most ceil(max_repeat) + 1: how many of its words each
    # takes (all, but for one cut short), and for which output shard.
    times = slots.groupBy("_s", "block").agg(F.array_sort(F.collect_list(F.struct("words", "shard"))).alias("slots"))
    part = F.expr("transform(slots, s -> named_struct('shard', s.shard, 'words', greatest(0L, least(s.words, in_block + hi - lo) - in_block)))")
    taken = pieces.join(times, ["_s", "block"]).withColumn("parts", part)
    taken = (taken.withColumn("cuts", F.col("slots.words"))
             .withColumn("taken", F.expr("aggregate(parts.words, 0L, (s, w) -> s + w)")).where("taken > 0"))
    taken = scratch.cut(taken.select("_id", "block", "in_block", "lo", "hi", "cuts", "parts", "taken"), "taken")
    per_shard = (taken.select("_id", F.explode("parts").alias("p")).where("p.words > 0")
                 .groupBy("_id", "p.shard").agg(F.sum("p.words").alias("words")))
    per_doc = per_shard.groupBy("_id").agg(F.sum("words").alias("taken"),
                                           F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shares"))
    docs = (sized.drop("_h", "_k").join(sources.select("_s", "source_size", "target"), "_s").join(per_doc, "_id", "left")
            .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
            .withColumn("shares", F.coalesce("shares", F.expr("cast(array() as array<struct<shard:int,words:bigint>>)"))))
    scratch.drop("pieces")
    return Mix(docs, slots, taken)


def _spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The words [lo, hi) of each span with the white space between them; spans
    that do not touch are set apart by a line break."""
    import re

    at = [(m.start(), m.end()) for m in re.finditer(C.WORD_CLASS, text)]
    return "\n".join(text[at[lo][0]:at[hi - 1][1]] for lo, hi in spans)


def _emit(batches, columns: list[str], text_at: int, chars_at: int | None):
    """Documents as often as the mix takes them; a copy has the words of the
    blocks that the mix takes at least that often.  Other columns stay Arrow values."""
    for b in batches:
        fields = b.column("_doc").flatten()
        whole, rows, texts, chars = fields[text_at], [], [], []
        for i, (size, pieces) in enumerate(zip(b.column("size").to_pylist(), b.column("pieces").to_pylist(), strict=True)):
            text = whole[i].as_py()
            cover = sorted((int(p["lo"]) + int(x), int(p["lo"]) + int(y), k) for p in pieces for x, y, k in p_runs(p))
            for copy in range(max(k for *_, k in cover)):
                spans: list[tuple[int, int]] = []
                for lo, hi, k in cover:
                    if k > copy:
                        if spans and spans[-1][1] == lo:
                            spans[-1] = (spans[-1][0], hi)
                        else:
                            spans.append((lo, hi))
                cut = spans != [(0, size)]
                rows.append(i)
                texts.append(_spans(text, spans) if cut else text)
                chars.append(len(texts[-1]) if cut or chars_at is None else fields[chars_at][i].as_py())
        out = [f.take(pa.array(rows, pa.int64())) for f in fields]
        out[text_at] = pa.array(texts, pa.string())
        if chars_at is not None:
            out[chars_at] = pa.array(chars, fields[chars_at].type)
        yield pa.RecordBatch.from_arrays(out, names=columns)


def p_runs(p) -> list[tuple[int, int, int]]:
    """Runs (from, to, times) of a piece, in words of the piece, that the cuts of
    its block cover."""
    n, at = int(p["hi"] - p["lo"]), int(p["in_block"])
    ends = sorted({min(n, max(0, int(c) - at)) for c in p["cuts"]} - {0})
    out, lo = [], 0
    for e in ends:
        out.append((lo, e, sum(int(c) - at >= e for c in p["cuts"])))
        lo = e
    return out


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: the input's columns, each document once for
    every time that the mix takes it, its text cut to the words taken.

    A document's pieces are at most size / block_words + 2 small rows; its text
    moves once, to be joined with them.
    """
    scratch = C.Scratch(docs.sparkSession, "mixing")
    keyed = C.numbered(docs, scratch, _k=F.xxhash64("doc_id", "text"), _s=C.group_key("source"), size=word_count(F.col("text")))
    keyed = keyed.withColumnRenamed("_m", "_id")
    m = mix(keyed.select("_id", "_k", "_s", "size"), scratch, **options)
    per = m.pieces.groupBy("_id").agg(F.collect_list(F.struct("in_block", "lo", "hi", "cuts")).alias("pieces"))
    cols = docs.columns
    chars = cols.index("n_chars") if "n_chars" in cols else None
    scratch.keep_only("numbered", "taken")
    whole = keyed.join(per, "_id").select("_doc", "size", "pieces")
    return whole.mapInArrow(lambda it: _emit(it, cols, cols.index("text"), chars), docs.schema)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """``shard_words`` says for which output shards the words are taken, as
    shard:words by shard, comma-joined."""
    docs = C.table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", F.monotonically_increasing_id().alias("_id"), F.xxhash64("doc_id", "text").alias("_k"),
                       C.group_key("source").alias("_s"), word_count(F.col("text")).alias("size"))
    shares = F.array_join(F.transform("shares", lambda s: F.concat_ws(":", s["shard"], s["words"])), ",")
    return mix(slim, C.Scratch(spark, "mixing")).documents.select("doc_id", "size", "source_size", "target", "taken", shares.alias("shard_words"))
