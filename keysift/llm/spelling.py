"""Grouping of spelling variants with bit-sliced position indexes.

Two words are near if one inserted, deleted or replaced character makes them equal.  Such an edit leaves two of three
parts of a word as they were, so the vocabulary is dealt into buckets by two parts at a time, and near words meet in one.
A bucket has an index of bitsets: for each (position, letter) the bucket's words with that
letter there.  For a query word, word-parallel recurrences follow the set of words
without an error so far and the three sets with one (replaced, inserted, deleted: the latter read the index one position on
or back), for all words of the bucket at a time.  Bits are ordered by frequency, so the most frequent near word is the lowest bit.

Each pair counts in one bucket only, the first of those it shares; no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import partitions, stage, table

# What a run of letters is, and which of them have a letter deleted.
RUN = "[A-Za-zÀ-ÿ]+"
EVERY = 31

#: Words have at least so many code points, and at least so many occurrences.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent as the word.
TIMES = 10
#: Larger buckets are compared tile by tile, in as many tasks.
TILE = 16_384
#: Buckets that are tiled, at most (the least size of a tiled bucket grows with the records, see ``tiled``).
TILED = 20_000

FOUND = "word string, n_near long, form_n long, form string"


# ------------------------------------------------------------------ the vocabulary


def observed(docs: DataFrame) -> DataFrame:
    """A row per run of letters: the word it stands for, ``word``.

    Where the crc32 of ``doc_id:run`` is a multiple of EVERY, one letter of the run is left out.
    """
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("own"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    # A shorter run can't become a word that is long enough.
    coded = runs.filter(F.length("run") >= LEAST_LENGTH).select("run", F.crc32(F.concat_ws(":", "own", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return coded.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words that are long and frequent enough."""
    counted = observed(docs).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


# ------------------------------------------------------------------ one bucket


def position_index(words: list[str]) -> tuple[dict[tuple[int, str], int], dict[int, int]]:
    """Bitsets of the words by (position, letter), and by length; word i is bit i."""
    places: dict[tuple[int, str], list[int]] = {}
    lengths: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        lengths.setdefault(len(word), []).append(i)
        for at in enumerate(word):
            places.setdefault(at, []).append(i)

    def bits(own: list[int]) -> int:
        if len(own) < 8:
            return sum(1 << i for i in own)
        raw = bytearray((own[-1] >> 3) + 1)
        for i in own:
            raw[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(raw, "little")

    return {at: bits(own) for at, own in places.items()}, {n: bits(own) for n, own in lengths.items()}


def one_error(word: str, index: dict[tuple[int, str], int], everything: int, mark: int) -> tuple[int, int, int, int]:
    """Bitsets of the words that ``word`` becomes by one replaced, one inserted or one deleted letter, lengths
    unchecked; and those that agree in the first ``mark`` letters."""
    exact, replaced, inserted, deleted, agree = everything, 0, 0, 0, everything
    get = index.get
    for i, letter in enumerate(word):
        here = get((i, letter), 0)
        same = exact & here
        replaced = replaced & here | (exact ^ same)
        inserted = (inserted | exact) & get((i + 1, letter), 0)
        deleted = deleted & get((i - 1, letter), 0) | exact
        exact = same
        if i + 1 == mark:
            agree = exact
    return replaced, inserted | exact, deleted, agree


def near_in_bucket(length: int, kind: int, words: list[str], queries: list[str]) -> Iterator[tuple[str, int, int]]:
    """(query, near words, number of the first of them) for the queries that have any in this bucket.

    The bucket compares words of ``length`` letters with each other and with those of one more.  Its kind says what they
    share: 1 all but the last third, 2 the first and last thirds, 3 all but the first.  What a pair
    shares in an earlier kind is left to that.
    """
    third = length // 3
    index, lengths = position_index(words)
    short, long = lengths.get(length, 0), lengths.get(length + 1, 0)
    everything = short | long
    mark = length - third if kind == 2 else third
    for word in queries:
        if everything.bit_count() < 2 and len(words) == len(queries):
            return
        replaced, inserted, deleted, agree = one_error(word, index, everything, mark)
        near = replaced & short | inserted & long if len(word) == length else deleted & short
        if kind > 1:
            near &= ~agree
        if near:
            yield word, near.bit_count(), (near & -near).bit_length() - 1


def bucket_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words of each bucket; rows come sorted by unit, and a unit may go on in the next batch."""
    found: list[tuple] = []

    def finish(rows: list[tuple]) -> None:
        if len(rows) < 2:
            return
        _, length, kind = rows[0][:3]
        indexed = sorted({(-n, word) for _, _, _, role, word, n in rows if role & 1})
        words = [word for _, word in indexed]
        queries = [word for _, _, _, role, word, _ in rows if role & 2]
        for word, near, first in near_in_bucket(length, kind, words, queries):
            found.append((word, near, -indexed[first][0], words[first]))

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].tolist() for c in ("unit", "length", "kind", "role", "word", "n"))):
            if held and row[0] != held[0][0]:
                finish(held)
                held = []
            held.append(row)
        if len(found) > 50_000:
            yield pd.DataFrame(found, columns=["word", "n_near", "form_n", "form"])
            found = []
    finish(held)
    yield pd.DataFrame(found, columns=["word", "n_near", "form_n", "form"])


# ------------------------------------------------------------------ buckets


def bucketed(words: DataFrame, least_length: int) -> DataFrame:
    """Six records a word: unit, length, kind, word, n.

    Pairs are compared at the length of their shorter word, so a word of m letters stands in buckets of
    length m and, with the words of one letter less, of length m - 1.
    """
    size, word = F.length("word"), F.col("word")

    def units(length: Column) -> Column:
        third = F.floor(length / 3).cast("int")
        head = lambda k: F.substring(word, F.lit(1), k)
        tail = lambda k: F.substring(word, size - k + 1, k)
        pieces = (head(length - third), F.concat(head(third), F.lit(" "), tail(third)), tail(length - third))
        named = [F.struct(F.concat_ws(":", length.cast("string"), F.lit(str(k)), piece).alias("unit"), length.alias("length"), F.lit(k).alias("kind")) for k, piece in enumerate(pieces, 1)]
        return F.array(*named)

    both = F.when(size > least_length, F.concat(units(size), units(size - 1))).otherwise(units(size))
    return words.select(F.explode(both).alias("u"), "word", "n").select("u.unit", "u.length", "u.kind", "word", "n")


def tiled(records: DataFrame) -> DataFrame:
    """Records with a role: 3, or in tiles of a large bucket 1 (indexed) or 2 (queried).

    A bucket of over ``max(TILE, records / TILED)`` words is cut into tiles; every tile of queries meets every tile
    of the index in a unit of its own.  There are at most TILED such buckets, so their list is broadcast.
    """
    keyed = records.withColumn("key", F.xxhash64("unit"))
    sizes = stage(keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > TILE), "large-buckets")
    bound = max(TILE, sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"] // TILED)
    large = sizes.filter(F.col("size") > bound).select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    joined = keyed.join(F.broadcast(large), "key", "left").withColumn("tile", tile)
    copies = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1),
            lambda other: F.when(F.col("tiles").isNull(), F.array(F.struct(F.col("unit").alias("unit"), F.lit(3).alias("role")))).otherwise(
                F.array(
                    F.struct(F.concat_ws(":", "unit", other.cast("string"), F.col("tile").cast("string")).alias("unit"), F.lit(1).alias("role")),
                    F.struct(F.concat_ws(":", "unit", F.col("tile").cast("string"), other.cast("string")).alias("unit"), F.lit(2).alias("role")),
                )
            ),
        )
    )
    return joined.select(F.explode(copies).alias("c"), "length", "kind", "word", "n").select("c.unit", "length", "kind", "c.role", "word", "n")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n_near, form_n, form of every word with a near word: their number, the most frequent one and its n."""
    records = tiled(bucketed(words, least_length))
    dealt = records.repartition(partitions(words.sparkSession), "unit").sortWithinPartitions("unit")
    partial = dealt.mapInPandas(bucket_rows, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), F.col("form").alias("form")))
    merged = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.rank")).alias("form_n"), F.col("best.form").alias("form"))


def variants(words: DataFrame, times: int = TIMES, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``words`` (staged) has distinct words, all of at least ``least_length`` code points, and their counts n.  The form is the near word of largest n, of equal ones
    the first in code-point order, if that is at least ``times`` n; the root is where following forms ends.
    """
    near = words.join(near_words(words, least_length), "word", "left")
    has = F.col("form_n") >= times * F.col("n")
    rows = stage(
        near.select(
            "word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")
        ),
        "variants",
    )
    # Each step multiplies n, so chains are short: their pointers are doubled until the longest possible one is done.
    steps, n = 0, LEAST_COUNT
    largest = words.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    while n <= largest and times > 1:
        steps, n = steps + 1, n * times
    pointers = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = pointers.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        moved = pointers.join(onward, F.col("root") == F.col("_from"), "left")
        pointers = stage(moved.select("word", F.coalesce("_to", "root").alias("root")), "roots")
    out = rows.join(pointers, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants of the words of all texts: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id counts as no digits where runs are coded; repeated
    rows count each; ties are settled by code-point order; a word may be as long as its text; an empty table
    gives no rows; other columns are ignored.
    """
    return variants(stage(vocabulary(docs), "vocabulary"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The crc32 is made byte by byte from its table; near words are found among words that agree once one letter is left out.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), kinds AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS own, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(regexp_replace(hex(encode(own)), '(..)', '\\1 ', 'g')[:-2], ' '), lambda x: CAST('0x' || x AS BIGINT))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM kinds, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM coded
), vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), shorter AS (
  SELECT word, n, unnest(range(-1, length(word))) AS i, CASE WHEN i < 0 THEN word ELSE word[:i] || word[i + 2:] END AS rest FROM vocabulary
), pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM shorter a JOIN shorter b
  ON a.rest = b.rest AND a.word <> b.word AND (a.i = b.i OR (a.i < 0 AND b.i >= 0) OR (b.i < 0 AND a.i >= 0))
), near AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM pairs GROUP BY word
), formed AS (
  SELECT v.word, CASE WHEN form_n >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM vocabulary v LEFT JOIN near USING (word)
), walk AS (
  SELECT word, word AS here, form AS onward FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.onward = f.word
)
SELECT word, form, here AS root, n, n_near, form_n FROM formed JOIN walk USING (word) WHERE onward IS NULL
"""
