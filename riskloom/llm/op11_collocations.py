"""Phrase collocations by partitioned frequent-phrase mining (SON).

A document falls into one of ``shards`` logical shards by a hash of its row.  Every
shard is mined completely, for phrases of one word, then two, three and four, at its
own local support: the support times the shard's share of all words, rounded up.  A
phrase below that in every shard is below the support in the whole, so the union of
the locally frequent phrases holds every frequent one.  Where the counts of a phrase
in the shards that report it, and one less than the local support for each other
shard, do not add up to the support, it leaves the union.  Tasks work on 64-bit hashes
of word runs, count them batch by batch, and Spark adds up the counts per shard; a
shard is never one task.  A run is counted only where the two runs one word shorter
inside it may be frequent, by a bitmap of ``2**BITMAP_BITS`` bits for each length.
Hash collisions and a crowded bitmap let more phrases through, never fewer.  A last
pass counts the phrases of the union exactly, as strings.

The bitmaps (8 MB for each length, whatever the corpus) are all that passes through
the driver.  Scores are exact in decimals.  Longer phrases report their counts to the
phrases inside them by one maximum aggregation; the parts of a cut are looked up by
equality joins, which adaptive execution splits on skew; the best of a language are
found by a window with a limit in every task first.

Defined results: null or empty text has no words; a null language is ``und``;
phrases do not cross the marks that end a piece; repeated rows all count; texts of
any length are cut at such marks for counting, one piece at least at a time; equal
scores are ordered by count, then phrase bytes; an empty table, or one without a
frequent phrase, gives an empty result; columns other than doc_id, lang and text are
ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import common as C

SUPPORT = 30
MAX_WORDS = 4
TOP = 2_000
#: A candidate inside a longer one with this share of its count is dropped.
COVERED_PERCENT = 80
#: Logical shards, their number in the low bits of a key.  Few are best: the higher the
#: local support, the closer the union is to the frequent phrases.
SHARDS, SHARD_BITS = 3, 3
#: Bytes of input, by the optimizer's estimate, that a task of the passes over repeated
#: keys takes at least, where there are two tasks for every core.
TASK_BYTES = 1 << 30
BITMAP_BITS = 26
#: Bytes of text whose runs are counted at a time.
SLICE_BYTES = 2 << 20
#: Distinct phrases that a task holds before it hands on their counts.
HELD_PHRASES = 1_000_000
#: Rows of one output batch of phrases.
OUT_ROWS = 50_000

#: Bytes: A-Z to lower case, marks that end a piece to line feed, tab to blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_BLANKS = re.compile(rb" {2,}")
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """The words of one slice of text: where they are, to which piece and document
    they belong, and a hash of each with its language."""

    def __init__(self, data: bytes, ends: np.ndarray, langs: np.ndarray, shards: np.ndarray):
        a = np.frombuffer(data, np.uint8)
        inside = (a != 10) & (a != 32)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.data, self.starts, self.ends = data, edge[0::2], edge[1::2]
        self.piece = np.cumsum(a == 10, dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        doc = np.searchsorted(ends, self.starts, side="right")
        self.lang, self.shard = langs[doc], shards[doc]
        # prefix sums of byte * base**position, all modulo 2**64
        power = np.cumprod(np.full(len(a), _BASE, np.uint64))
        back = np.cumprod(np.full(len(a), pow(_BASE, -1, 1 << 64), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power)))
        raw = (sums[self.ends] - sums[self.starts]) * (back[self.starts] if len(self.starts) else np.zeros(0, np.uint64))
        self.hashes = _mix(raw + (self.ends - self.starts).astype(np.uint64))

    def runs(self, lang_hash: np.ndarray, bitmaps: list[np.ndarray], upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length up to ``upto``: the first words of the runs that lie in
        one piece and whose parts may be frequent, and their hashes."""
        w = _mix(self.hashes + lang_hash[self.lang]) if len(self.hashes) else self.hashes
        at, h = np.arange(len(w)), w
        yield at, h
        for k in range(2, upto + 1):
            may = np.zeros(len(w) + 1, bool)
            may[at] = _held(bitmaps[k - 2], h)
            first = may[at] & may[np.minimum(at + 1, len(w))]
            at, h = at[first], h[first]
            same = self.piece[at] == self.piece[np.minimum(at + k - 1, len(w) - 1)] if len(at) else np.zeros(0, bool)
            same &= at + k - 1 < len(w)
            at, h = at[same], h[same]
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w[at + k - 1])
            yield at, h


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    pos = h >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _cut(data: bytes) -> Iterator[bytes]:
    """A text in parts of some ``SLICE_BYTES`` that end where a piece ends."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        end = data.rfind(b"\n", at, at + SLICE_BYTES)
        end = end if end >= 0 else data.find(b"\n", at + SLICE_BYTES)
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:]


def _slices(batches) -> Iterator[tuple[_Words, list[str]]]:
    """The words of the texts, some ``SLICE_BYTES`` at a time, and the names that the
    words' language numbers stand for."""
    names: list[str] = []
    code: dict[str, int] = {}
    parts: list[bytes] = []
    langs: list[int] = []
    shards: list[int] = []
    size = 0

    def words():
        ends = np.cumsum([len(p) + 1 for p in parts])
        return _Words(b"\n".join(parts) + b"\n", ends, np.array(langs), np.array(shards)), names

    for b in batches:
        for lang, shard, text in zip(b.column("lang").to_pylist(), b.column("shard").to_pylist(), b.column("text"), strict=True):
            if lang not in code:
                code[lang] = len(names)
                names.append(lang)
            data = _BLANKS.sub(b" ", text.as_buffer().to_pybytes().translate(_TABLE)) if text.is_valid else b""
            for part in _cut(data):
                parts.append(part)
                langs.append(code[lang])
                shards.append(shard)
                size += len(part)
                if size >= SLICE_BYTES:
                    yield words()
                    parts, langs, shards, size = [], [], [], 0
    if parts:
        yield words()


def _lang_hashes(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)


def _count_runs(length: int, bitmaps):
    """Counts of the runs of ``length`` words: (key, n) per slice, a key being a hash of
    language and run with the shard in its low bits."""
    def run(batches):
        held = [b.value for b in bitmaps]
        low = np.uint64((1 << SHARD_BITS) - 1)
        for words, names in _slices(batches):
            for k, (at, h) in enumerate(words.runs(_lang_hashes(names), held, length), 1):
                if k == length and len(at):
                    key, n = np.unique((h & ~low) | words.shard[at].astype(np.uint64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def _count_phrases(bitmaps, max_words: int):
    """Exact counts of the phrases that the bitmaps let through: (lang, words, phrase,
    n); 0 words and no phrase stand for all words of the language."""
    def run(batches):
        held = [b.value for b in bitmaps]
        counts: dict[tuple[str, int], Counter] = {}

        def flush():
            for (lang, k), c in counts.items():
                left = iter(c.items())
                while some := list(itertools.islice(left, OUT_ROWS)):
                    phrases, n = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([k] * len(some), pa.int32()),
                         pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                        names=["lang", "words", "phrase", "n"])
            counts.clear()

        for words, names in _slices(batches):
            for code, n in enumerate(np.bincount(words.lang, minlength=len(names)).tolist()):
                counts.setdefault((names[code], 0), Counter())[b""] += n
            for k, (at, h) in enumerate(words.runs(_lang_hashes(names), held, max_words), 1):
                at = at[_held(held[k - 1], h)]
                lang = words.lang[at]
                for code in np.unique(lang):
                    mine = at[lang == code]
                    spans = map(slice, words.starts[mine].tolist(), words.ends[mine + k - 1].tolist())
                    counts.setdefault((names[code], k), Counter()).update(map(words.data.__getitem__, spans))
            if sum(map(len, counts.values())) > HELD_PHRASES:
                yield from flush()
        yield from flush()

    return run


def _merged(rows: DataFrame) -> DataFrame:
    """Fewer, longer scan tasks: counts of words and of frequent phrases meet in the
    task, so that the rows shuffled do not grow with splits times phrases."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return rows.coalesce(min(tasks, 2**31 - 1))  # a frame of unknown size counts as the largest


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of the keys' top ``BITMAP_BITS`` bits, put together by Spark in pieces
    of 4 KB; at most ``2**BITMAP_BITS`` bits in all."""
    pos = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    pieces = (keys.select((pos / 32768).cast("long").alias("piece"), (pos % 32768).cast("long").alias("bit")).groupBy("piece")
              .agg(F.bitmap_construct_agg("bit").alias("bits")))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in pieces.collect():
        out[r["piece"] * 4096:(r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, scratch: C.Scratch, support: int = SUPPORT, max_words: int = MAX_WORDS,
                     shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of every phrase that occurs ``support`` times or more
    in its language, and (lang, n), the languages' words."""
    if not 1 <= shards <= 1 << SHARD_BITS:
        raise ValueError("1 to 8 shards")
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text",
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    shard = F.col("key").bitwiseAND((1 << SHARD_BITS) - 1).cast("int")
    bitmaps: list = []

    def mined(length: int) -> DataFrame:
        read = _merged(rows) if length == 1 else rows
        return read.mapInArrow(_count_runs(length, bitmaps), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    words = scratch.cut(mined(1), "words")
    size = {r["shard"]: r["n"] for r in words.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n")).collect()}  # a row a shard
    least = [max(1, -(-support * size.get(s, 0) // max(1, sum(size.values())))) for s in range(shards)]
    local = F.element_at(F.array(*[F.lit(x) for x in least]), shard + 1)
    for length in range(1, max_words + 1):
        frequent = (words if length == 1 else mined(length)).where(F.col("n") >= local)
        # what it has at most: its counts, and least - 1 in every shard that does not report it
        most = F.sum(F.col("n") - local + 1) + F.lit(sum(least) - len(least))
        union = frequent.groupBy(F.col("key").bitwiseAND(~((1 << SHARD_BITS) - 1)).alias("key")).agg(most.alias("most"))
        bitmaps.append(sc.broadcast(_bitmap(union.where(F.col("most") >= support))))
    counted = (_merged(rows).mapInArrow(_count_phrases(bitmaps, max_words), "lang string, words int, phrase string, n long")
               .groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")))
    counted = scratch.cut(counted.where((F.col("words") == 0) | (F.col("f") >= support)), "phrases")
    for b in bitmaps:
        b.destroy()
    scratch.drop("words")
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut."""
    count = phrases.select("lang", F.col("phrase").alias("part"), "f")
    found = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = (found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("rest", F.expr("substring(phrase, length(first) + 2)")))
    cuts = (cuts.join(count.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
            .join(count.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)").alias("score")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
                   " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = (phrases.where("words >= 3").select("lang", F.explode(spans).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("around")))
    kept = (weakest.join(longer, ["lang", "phrase"], "left")
            .where(f"around IS NULL OR 100 * around < {covered_percent} * a"))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return (kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score")))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return collocations(*frequent_phrases(docs, C.Scratch(spark, "collocations")))


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM i, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
u AS (SELECT c.*, unnest(range(1, k)) AS cut_at FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut_at, l.f AS l, r.f AS r,
             CAST((2000000::HUGEINT * u.a) // (l.f + r.f) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:u.cut_at], ' ')
             JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.cut_at + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
inner_phrases AS (
  SELECT c.lang, array_to_string(c.ws[j:j + m - 1], ' ') AS phrase, max(c.a) AS around
  FROM c, (VALUES (2), (3)) AS ms(m), (VALUES (1), (2), (3)) AS js(j)
  WHERE m < c.k AND j + m - 1 <= c.k GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN inner_phrases x ON x.lang = b.lang AND x.phrase = b.phrase
      WHERE x.around IS NULL OR 100 * x.around < 80 * b.a)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n.n AS n, score
FROM d JOIN n ON n.lang = d.lang
QUALIFY row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
