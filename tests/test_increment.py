"""The incremental index equals one built at once, whatever the order of the batches."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import postings
from spindrift.streaming import increment

WORDS = [f"w{i}" for i in range(25)]


def changes(seed=1):
    """Adds, changes and deletions of forty items with shuffled seqs, a tie of seqs, rows that are no changes."""
    rng = random.Random(seed)
    out = []
    for item in range(40):
        for seq in rng.sample(range(100), rng.randrange(1, 5)):
            gone = rng.random() < 0.25
            out.append((item, seq, None if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))), gone))
    out += [(50, 1, "tie one", False), (50, 1, "tie two", False), (51, 1, "kept", False), (51, 1, "kept", True), (52, 3, "same", None), (52, 3, "same", None)]
    return [*out, (None, 1, "no item", False), (60, None, "no seq", False)]


def final(rows, hashes):
    best = {}
    for item, seq, text, gone in rows:
        if item is not None and seq is not None:
            v = ((seq, bool(gone), hashes[text or ""]), text or "", bool(gone))
            best[item] = max(best.get(item, v), v)
    return {i: t for i, (_, t, gone) in best.items() if not gone}


def state(inc):
    return sorted(map(str, inc.terms().collect())), inc.size(), sorted(map(str, inc.counts().collect())), sorted(map(str, inc.lengths().collect()))


@pytest.fixture(scope="module")
def wanted(spark):
    rows = changes()
    texts = sorted({t or "" for _, _, t, _ in rows})
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    live = spark.createDataFrame(sorted(final(rows, hashes).items()), "item long, text string")
    counts, sizes = postings.token_counts(live, "item", "text"), postings.lengths(live, "item", "text")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    r = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
    return live, (sorted(map(str, df.collect())), (r.n, r.a), sorted(map(str, counts.collect())), sorted(map(str, sizes.collect())))


@pytest.mark.parametrize("order", [0, 1, 2])
def test_any_order_of_batches(spark, wanted, tmp_path, order):
    rows = changes()
    random.Random(order).shuffle(rows)
    inc = increment.Increment(spark, f"file://{tmp_path}/i")
    assert inc.size() == (0, 1.0) and inc.terms().count() == 0
    cut = [0, 30, 31, 70, len(rows)]
    for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        df = spark.createDataFrame(rows[a:b], increment.CHANGE)
        inc.apply(df, i)
        if i == order:
            inc.apply(df, i)  # as after a failure
        if i == 2 and order == 1:
            inc.compact(2)
    got = state(inc)
    assert got[1][0] == wanted[1][1][0] and abs(got[1][1] - wanted[1][1][1]) < 1e-12
    assert (got[0], *got[2:]) == (wanted[1][0], *wanted[1][2:])
    if order == 1:
        inc.compact(3)
        assert state(inc) == got
        with pytest.raises(ValueError, match="applied already"):
            inc.apply(spark.createDataFrame([(70, 1, "new", False)], increment.CHANGE), 9)
            inc.compact(5)


def test_stream_and_search(spark, wanted, tmp_path):
    rows, feed = changes(), f"file://{tmp_path}/feed"
    random.Random(9).shuffle(rows)
    inc = increment.Increment(spark, f"file://{tmp_path}/i")
    for part in (rows[:50], rows[50:]):  # the query ends, and goes on from its checkpoint
        spark.createDataFrame(part, increment.CHANGE).repartition(2).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(increment.CHANGE).option("maxFilesPerTrigger", 1).parquet(feed)
        inc.follow(stream, f"{tmp_path}/check").awaitTermination()
    live, want = wanted
    assert state(inc)[0] == want[0]
    q = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w9")], "id long, text string")
    plain = postings.Postings.build(postings.token_counts(live, "item", "text"), postings.lengths(live, "item", "text"), f"file://{tmp_path}/a")
    key = lambda r: (r.query, r["rank"], r.item, round(r.score, 7))
    assert sorted(map(key, inc.index(f"file://{tmp_path}/b").top(q, "id", "text", 5).collect())) == sorted(map(key, plain.top(q, "id", "text", 5).collect()))
    assert {r.term: round(r.idf, 9) for r in inc.idf().collect()} == {r.term: round(r.idf, 9) for r in plain.idf.collect()}
