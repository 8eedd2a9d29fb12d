"""Runs of line hashes on disk and in plans; the mixture's draw, permutation and join
against a plain computation."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import common as C
from riskloom.llm import op1_line_dedup as L
from riskloom.llm import op9_mixing as M


def _files(spark, name):
    """Files per bucket of a run, and whether each is sorted."""
    paths = [r[0] for r in spark.table(name).select(F.input_file_name()).distinct().collect()]
    buckets = Counter(re.search(r"_(\d{5})(\.c\d+)", p).group(1) for p in paths)
    rows = [spark.read.parquet(p).toPandas() for p in paths]
    return buckets, all(list(zip(r.h1, r.h2)) == sorted(zip(r.h1, r.h2)) for r in rows)


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_have_one_sorted_file_a_bucket_at_every_level(spark, fanout):
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")   # a scan of a run would be many splits
    try:
        with L.LineRuns(spark, C.Scratch(spark, "t"), fanout) as runs:
            levels, n = set(), 0
            for b in range(fanout * fanout):
                runs.add(spark.range(b * 5000, (b + 1) * 5000).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2")))
                n += 5000
                for level, name in runs.runs:
                    buckets, ordered = _files(spark, name)
                    assert ordered and set(buckets.values()) == {1} and len(buckets) <= runs.buckets
                    levels.add(level)
                assert sum(spark.table(name).count() for _, name in runs.runs) == n
            assert levels == {0, 1, 2}
            merge = runs.merged(runs.runs[0][1], runs.runs[0][1])._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in merge and "Exchange" not in merge and not re.search(r"\bSort \[", merge)
            new = spark.range(100).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n"))
            plan = runs.look_up(new)._jdf.queryExecution().executedPlan().toString()
            # The batch is shuffled and sorted once; the stored side is neither.
            assert "SortMergeJoin" in plan and len(re.findall(r"\bSort \[", plan)) == 1 and plan.count("Exchange") == 1
            assert runs.look_up(new).where("known").count() == 100
            names = [name for _, name in runs.runs]
        assert not any(spark.catalog.tableExists(n) for n in names) and spark.conf.get(runs.ORDERED) == "false"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_runs_go_when_a_step_fails(spark):
    with pytest.raises(ZeroDivisionError):
        with L.LineRuns(spark, C.Scratch(spark, "t")) as runs:
            runs.add(spark.range(10).select(F.col("id").alias("h1"), F.col("id").alias("h2")))
            name = runs.runs[0][1]
            raise ZeroDivisionError
    assert not spark.catalog.tableExists(name)


def _signed(spark, sources, seed):
    """Sources' hashes as the operator takes them."""
    df = spark.createDataFrame([(s,) for s in sources], "_s string")
    return {r["_s"]: r["h"] for r in df.select("_s", F.xxhash64(F.lit(seed), "_s").alias("h")).collect()}


def _by_hand(spark, rows, targets, seed, n_shards, block):
    """Words per (id, shard) by walking every slot word by word."""
    order = {r["_id"]: r["h"] for r in spark.createDataFrame([(i, k) for i, k, *_ in rows], "_id long, _k long")
             .select("_id", F.xxhash64(F.lit(seed), "_k").alias("h")).collect()}
    keys, out = _signed(spark, targets, seed + 1), defaultdict(int)
    for s, target in targets.items():
        stream = [i for i, k, _, n in sorted((r for r in rows if r[2] == s), key=lambda r: (order[r[0]], r[1], r[0])) for _ in range(n)]
        size, want = len(stream), int(min(round(target), 3 * len(stream)))
        n_blocks = -(-size // block)
        passes, rest = divmod(want, size)
        n_slots = passes * n_blocks + min(n_blocks, -(-rest // block) + (rest > 0))
        rng = np.random.default_rng([seed, keys[s] & 0xFFFFFFFF, (keys[s] >> 32) & 0xFFFFFFFF])
        drawn = rng.multinomial(n_slots, [1.0 / n_shards] * n_shards)
        shards = [shard for shard, c in enumerate(drawn.tolist()) for _ in range(c)]
        left = rest
        for j, shard in enumerate(shards):
            key = np.uint64((keys[s] + j // n_blocks) % 2**64)
            at = int(M._permute(np.array([j % n_blocks]), np.array([n_blocks]), np.array([key]))[0])
            words = stream[at * block:(at + 1) * block]
            if j // n_blocks == passes:
                words, left = words[:left], left - min(left, len(words))
            for i in words:
                out[i, shard] += 1
    return dict(out)


@pytest.mark.parametrize("seed,n_shards", [(M.SEED, 5), (1, 5), (M.SEED, 1)])
def test_draw_permutation_and_join_by_hand(spark, seed, n_shards):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(1, 9)) if i % 4 else i, "0" if i % 9 == 0 else "1" + "abcd"[i % 4], int(rng.choice([0, 1, 5, 40, 333]))) for i in range(160)]
    df = spark.createDataFrame(rows, "_id long, _k long, _s string, size long").repartition(5)
    got = M.mix(df, C.Scratch(spark, "t"), block_words=16, n_shards=n_shards, seed=seed).documents.collect()
    targets = {r["_s"]: r["target"] for r in got}
    want = _by_hand(spark, rows, targets, seed, n_shards, 16)
    assert {(r["_id"], s["shard"]): s["words"] for r in got for s in r["shares"]} == want
    for r in got:
        assert r["taken"] == sum(s["words"] for s in r["shares"]) <= 3 * r["size"]
        assert [s["shard"] for s in r["shares"]] == sorted({s["shard"] for s in r["shares"]})
    for s, t in targets.items():
        assert abs(sum(r["taken"] for r in got if r["_s"] == s) - t) <= 1


def test_another_draw_gives_another_result(spark):
    df = spark.range(300).select(F.col("id").alias("_id"), F.col("id").alias("_k"), F.concat(F.lit("1"), F.col("id") % 3).alias("_s"), F.lit(50).cast("long").alias("size"))
    shares = [{r["_id"]: r["shares"] for r in M.mix(df, C.Scratch(spark, "t"), block_words=16, n_shards=n, seed=s).documents.collect()}
              for n, s in ((4, 1), (4, 1), (4, 2), (8, 1))]
    assert shares[0] == shares[1] and shares[0] != shares[2] and shares[0] != shares[3]
