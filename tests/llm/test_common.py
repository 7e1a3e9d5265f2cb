import pytest
from pyspark.sql import functions as F

from keysift.llm.common import WordCache, attach, suspected


@pytest.mark.parametrize("bits", [8, 1 << 15, 1 << 26])
def test_suspected_misses_no_key(spark, bits):
    rows = spark.range(2000).selectExpr("concat('k', id) as k", "id")
    keys = spark.range(0, 2000, 9).selectExpr("concat('k', id) as k", "1 as x")
    marked = suspected(rows, keys, "k", "hit", bits)
    assert marked.columns == ["k", "id", "hit"] and marked.count() == 2000
    assert marked.filter("hit").join(keys, "k").count() == keys.count()
    assert bits < 1 << 20 or marked.filter("hit").count() < 240
    assert suspected(rows, keys.limit(0), "k", "hit", bits).filter("hit").count() == 0


def test_attach_serves_heavy_and_light_keys(spark):
    rows = spark.range(5000).selectExpr("case when id < 2500 then 'hot' else concat('k', id % 7) end as k", "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    groups = groups.filter("k != 'k3'")
    tops = {r.k: r.top for r in groups.collect()}
    for own in (F.col("id"), F.lit(None).cast("long")):  # rows without an id of their own are spread all the same
        found = attach(rows, groups, "k", "n", ["top"], own)
        assert found.count() == 5000 and all(r.top == tops.get(r.k) for r in found.collect())


def test_word_cache_is_bounded_in_bytes():
    made = []
    cache = WordCache(lambda word: made.append(word) or b"x" * len(word), room=3000)
    for i in range(100):
        assert cache[b"w%d" % i] == b"x" * len(b"w%d" % i) and cache[b"often"] == b"xxxxx"
        assert cache.held <= 3000 + 700 and len(cache) <= 20 and len(cache.older) <= 20
    assert made.count(b"often") == 1
    blob = b"b" * 1_000_000
    assert cache[blob] == b"x" * 1_000_000 and blob not in cache and blob not in cache.older


def test_word_cache_memory():
    """A million short words and a thousand of a megabyte stay under 60 MB in a cache of 20."""
    import tracemalloc

    tracemalloc.start()
    cache = WordCache(lambda word: word[::-1], room=20 << 20)
    for i in range(1_000_000):
        cache[b"word-%d" % i]
    for i in range(1000):
        cache[b"%d" % i * 200_000]
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 60 << 20
