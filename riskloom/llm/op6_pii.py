"""Personal data: patterns for four kinds, and bootstrapped contextual extraction.

The base spans (e-mail, IP address, card, phone) come from fixed patterns and
their checks.  They are the seeds of a graph.  An instance is a whole base span
with the words that it meets, or else a run of words of digits, brackets, dots and
hyphens with blanks or a lone hyphen or dot between, or else a single word that
holds a digit or an @; a run of more than ``MAX_DIGITS`` digits is a row of numbers,
whose words are instances each.  The two words before an instance are its lexical
pattern, where an instance before it counts as one word of its own, ``HELD``; an
instance with less than two words before it in the text has no pattern.  In rounds,
a pattern's confidence in a kind is the mean confidence of its instances, and an
unseen instance takes that of its best supported pattern.  Patterns that keep a
high confidence and are backed by enough different seeds give their kind to the
unseen instances behind them; base spans are never changed.

DataFrame functions only.  A match's place follows from the lengths of the text's
pieces between matches, summed up per document, so each pattern reads a text
twice and no text leaves its scan.  Texts without a digit or @ are not searched:
no pattern matches them.  Graph edges are summed before they are joined.

Defined results: null and empty text have no spans; rows that repeat a doc_id, or
have none, are searched each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import common as C

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Repeats are possessive where what follows
# cannot begin with what they take, and an e-mail starts only where its run of
# characters or the rest behind the last match does: the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NO_SPACE = r"[^\x20\x09-\x0D]"
#: A word with a digit or an @.
INSTANCE = r"(?<!" + _NO_SPACE + r")[^\x20\x09-\x0D0-9@]*+[0-9@]" + _NO_SPACE + "*+"
#: The last words, two at most, between two instances; words are looked for in the last CONTEXT characters.
LEFT = "((?:" + _NO_SPACE + r"+[\x20\x09-\x0D]+){1,2})$"
CONTEXT = 80
HELD = "0"  # holds a digit, so no other word of a pattern is the same
TRIM = r"\"'`()\[\]{}<>|,;:.!?"
#: What a run's first and last word lose: not the brackets around digits.
LEAD = r"^(?:(?![(\[][0-9]+[)\]])[" + TRIM + "])*+"
TAIL = "(?:[" + TRIM + r"](?<![(\[][0-9]{1,19}[)\]]))++$"
#: A word that a run can hold, and what may lie between two of them.
DIGITS = r"^\+?[0-9().\[\]-]+$"
JOIN = r"^\x20+(?:[.-]\x20+)?$"
MAX_DIGITS = 19
ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.7
MIN_LENGTH = 5


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The check that a base match of the kind must pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        def part(p: Column) -> Column:
            p = F.regexp_replace(p, "^0+", "")
            return F.when(p == "", True).when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255)

        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, when: Column, left: bool = False) -> Column:
    """Array of (gap, match, left, near): length of the text before each match since
    the last, the match, the words there, and if it may join two words of a run."""
    pieces = F.split(text, pattern, -1)
    gaps = F.transform(pieces, lambda p: F.struct(
        F.length(p).alias("gap"),
        (F.regexp_extract(F.right(p, F.lit(CONTEXT)), LEFT, 1) if left else F.lit("")).alias("left"),
        (p.rlike(JOIN) if left else F.lit(False)).alias("near")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # As many gaps as matches: the last piece has no match behind it.
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                        lambda g, m: F.struct(g["gap"].alias("gap"), m.alias("match"), g["left"].alias("left"), g["near"].alias("near")))
    return F.when(when, zipped)


def _placed(found: DataFrame, column: str) -> DataFrame:
    """(_r, gap, match, left, near, start, end) of an array of matches per row."""
    rows = found.where(F.size(column) > 0).select("_r", F.posexplode(column).alias("i", "m"))
    w = Window.partitionBy("_r").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.match")).over(w)
    return (rows.withColumn("end", end.cast("long"))
            .select("_r", "m.*", (F.col("end") - F.length("m.match")).alias("start"), "end"))


def _units(word: DataFrame, base: DataFrame) -> DataFrame:
    """(_r, start, end, value, kind, at, to, ...): the words, those that meet base
    spans as one with them; value and kind are those of the first span, or kind is
    null.  at and to are the ends without trimming, the rest is of the first word."""
    first = F.struct("start", "gap", "left", "near", "match")
    span = F.struct("start", "k", "end", "match", "kind")
    both = word.select("_r", "start", "end", first.alias("word"), F.lit(None).cast("struct<start:bigint,k:int,end:bigint,match:string,kind:string>").alias("span"))
    both = both.unionByName(base.select("_r", "start", "end", span.alias("span")), allowMissingColumns=True)
    w = Window.partitionBy("_r").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn(
        "unit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy("_r", "unit").agg(F.min("start").alias("at"), F.max("end").alias("to"), F.min("span").alias("span"),
                                          F.min("word").alias("word")).select("_r", "unit", "at", "to", "span", "word.gap", "word.left", "word.near", "word.match")


def _instances(found: DataFrame, base: DataFrame) -> DataFrame:
    """(_r, start, end, value, left, kind): the instances and their patterns; kind is
    that of the base span, or null."""
    unit = _units(_placed(found, "word"), base)
    alone = F.col("span").isNull()
    lead, tail = F.length(F.regexp_extract("match", LEAD, 0)), F.length(F.regexp_extract("match", TAIL, 0))
    core = F.regexp_replace(F.regexp_replace("match", LEAD, ""), TAIL, "")
    unit = unit.withColumn("lead", lead).withColumn("tail", tail).withColumn("core", core)
    unit = unit.withColumn("run", alone & F.col("core").rlike(DIGITS))
    w = Window.partitionBy("_r").orderBy("at")
    joins = (F.col("run") & F.col("near") & (F.col("lead") == 0) & ~F.startswith("core", F.lit("+"))
             & F.lag(F.col("run") & (F.col("tail") == 0), 1, False).over(w))
    unit = unit.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn(
        "i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = Window.partitionBy("_r", "i")
    long = F.sum(F.length(F.regexp_replace("core", "[^0-9]", ""))).over(of) > MAX_DIGITS
    # The words of a row of numbers are numbered apart, behind their row.
    unit = unit.withColumn("j", F.when(F.col("run") & long, F.col("unit")).otherwise(0))
    part = F.struct("at", "to", "lead", "tail", "core", "match", "gap", "left")
    per = unit.groupBy("_r", "i", "j").agg(F.array_sort(F.collect_list(part)).alias("u"), F.min("span").alias("span"))
    a, z, one = F.col("u")[0], F.element_at("u", -1), F.size("u") == 1
    bare = F.regexp_replace(a["match"], f"^[{TRIM}]+|[{TRIM}]+$", "")
    bare_at = a["at"] + F.length(F.regexp_extract(a["match"], f"^[{TRIM}]*", 0))
    joined = F.array_join(F.transform("u", lambda x: x["core"]), " ")
    met = F.col("span").isNotNull()
    per = per.select(
        "_r", a["at"].alias("at"), a["gap"].alias("gap"), F.trim(F.regexp_replace(F.lower(a["left"]), r"[\x20\x09-\x0D]+", " ")).alias("words"),
        F.when(met, F.col("span.start")).when(one, bare_at).otherwise(a["at"] + a["lead"]).alias("start"),
        F.when(met, F.col("span.end")).when(one, bare_at + F.length(bare)).otherwise(z["to"] - z["tail"]).alias("end"),
        F.lower(F.when(met, F.col("span.match")).when(one, bare).otherwise(joined)).alias("value"), F.col("span.kind").alias("kind"))
    # Words before: those since the last instance, then that instance, and so on.
    per = per.withColumn("words", F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " ")))
    held = F.when(F.row_number().over(w) > 1, F.array(F.lit(HELD))).otherwise(F.array().cast("array<string>"))
    per = per.withColumn("all", F.concat(held, "words")).withColumn("cut", (F.size("words") < 2) & (F.col("gap") > CONTEXT))
    last = F.lag(F.when(F.col("cut"), F.array(F.lit(None).cast("string"))).otherwise(F.col("all"))).over(w)
    before = F.concat(F.coalesce(last, F.array().cast("array<string>")), "all")
    two = F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2)
    left = F.when(F.col("cut") | (F.size(before) < 2), "").when(F.exists(two, lambda x: x.isNull()), "").otherwise(F.array_join(two, " "))
    return per.withColumn("_left", left).where("value <> ''").select("_r", "start", "end", "value", F.col("_left").alias("left"), "kind")


def confident_patterns(instances: DataFrame, scratch: C.Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(left, kind) of the patterns that the graph trusts."""
    edges = (instances.where("left <> ''").groupBy("left", "value")
             .agg(*[F.max((F.coalesce("kind", F.lit("")) == k).cast("double")).alias(k) for k in KINDS]))
    edges = scratch.cut(edges, "edges")
    seed = scratch.cut(edges.groupBy("value").agg(*[F.max(k).alias(k) for k in KINDS]), "seeds")
    conf, chosen = seed, None
    for r in range(rounds):
        # A pattern's confidence is the mean over its different instances.
        per = edges.select("left", "value").join(conf, "value").groupBy("left").agg(
            *[F.avg(k).alias(k) for k in KINDS])
        backed = edges.groupBy("left").agg(*[F.sum(k).alias(f"{k}_seeds") for k in KINDS])
        strong = [F.when(F.col(f"{k}_seeds") >= MIN_SEEDS, F.col(k)).otherwise(0.0).alias(k) for k in KINDS]
        scored = per.join(backed, "left").select("left", *strong).where(" OR ".join(f"{k} > 0" for k in KINDS))
        chosen = scratch.cut(scored, f"patterns{r}")
        if not chosen.limit(1).count():
            break  # no pattern has enough seeds, so no instance gains confidence
        gained = edges.select("left", "value").join(chosen, "left").groupBy("value").agg(*[F.max(k).alias(f"g_{k}") for k in KINDS])
        conf = scratch.cut(seed.join(gained, "value", "left").select(
            "value", *[F.greatest(k, F.coalesce(f"g_{k}", F.lit(0.0))).alias(k) for k in KINDS]), f"confidence{r}")
    kind = F.array_max(F.array(*[F.struct(F.col(k).alias("c"), F.lit(k).alias("kind")) for k in KINDS]))
    return chosen.select("left", kind.alias("_k")).where(F.col("_k.c") >= MIN_CONFIDENCE).select("left", F.col("_k.kind").alias("kind"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def find_spans(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Per row: doc_id, n_<kind> and base_sha256 of the base spans, spans of all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    searched = text.rlike("[0-9@]")
    when = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"),
            "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("_r"),
                        *[_matches(text, PATTERNS[k], searched & when[k]).alias(k) for k in KINDS],
                        _matches(text, INSTANCE, searched, left=True).alias("word"))
    found = scratch.cut(found, "found")
    base = None
    for i, k in enumerate(KINDS):
        rows = _placed(found, k).where(passes(k, F.col("match"))).select(
            "_r", "start", "end", "match", F.lit(k).alias("kind"), F.lit(i).alias("k"))
        base = rows if base is None else base.unionByName(rows)
    base = scratch.cut(base, "base")
    instances = scratch.cut(_instances(found.select("_r", "word"), base), "instances")
    patterns = confident_patterns(instances, scratch)
    index = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    new = (instances.where(F.col("kind").isNull() & (F.length("value") >= MIN_LENGTH)).drop("kind").join(patterns, "left")
           .select("_r", "start", "end", "kind", index.alias("k")))
    spans = base.drop("match").withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)))
    key = F.struct("start", "k", "end")
    per = spans.groupBy("_r").agg(*[F.sum(((F.col("kind") == k) & F.col("base")).cast("long")).alias(f"n_{k}") for k in KINDS],
                                  F.collect_list(F.when(F.col("base"), key)).alias("b"), F.collect_list(key).alias("a"))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    out = found.select("doc_id", "_r").join(per, "_r", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(_joined(F.coalesce("b", none)), 256).alias("base_sha256"), _joined(F.coalesce("a", none)).alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return find_spans(C.table(spark, sf_dir, "documents"), C.Scratch(spark, "pii"))
