"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link if they differ in at most ``max_bits`` bits.  Their bits are cut into m
partitions with thresholds t_1..t_m whose sum is max_bits - m + 1: two fingerprints that link differ by at most
t_i bits in some partition i, so looking up all values within t_i of each partition's value
finds every link.  Correlated bits share a partition, which leaves the others closer to
independent; m and the thresholds come from dynamic programming on estimated look-up and candidate counts.
Candidates are verified inside their bucket, and a bucket passes on a spanning forest
of its links instead of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import attach, partitions, stage, suspected, table, text_of
from keysift.llm.components import components

WORDS = 3
MAX_BITS = 3
#: Larger buckets are compared tile by tile, in as many tasks.
TILE = 4096
#: Relative costs of a look-up record that is shuffled and of a candidate that is compared.
LOOKUP_COST, CANDIDATE_COST = 2000.0, 4.0


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # of bytes, both look at ASCII only
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1).tolist()
    starts = [0, *ends]
    return np.array([xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits: those set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes from given ones."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def fingerprints(docs: DataFrame, words: int = WORDS, column: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of its text as a long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(majority(shingle_hashes(t, words))) for t in texts], dtype="int64")

    return docs.withColumn(column, simhash(text_of()))


def bits_for(similarity: float, bits: int) -> int:
    """SimHash bits in which two shingle sets of a Jaccard similarity differ on average, rounded up,
    plus one standard deviation: sets of similarity J have the cosine 2J / (1 + J)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + math.sqrt(bits * p * (1 - p)))


# ------------------------------------------------------------------ the plan of look-ups


def bit_groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Cut 64 bits into m groups of nearly equal size, each grown from a free bit by the free bit most correlated with it."""
    free, groups = set(range(64)), []
    strength = np.abs(correlation)
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        group = [max(free, key=lambda b: (strength[b, list(free)].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with sum ``total``; ``costs[i][t + 1]`` is the cost of threshold t, from -1, in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in enumerate(row, -1):
                if spent + t not in then or cost + more < then[spent + t][0]:
                    then[spent + t] = (cost + more, [*chosen, t])
        best = then
    return best[total]


def plan(distinct: DataFrame, max_bits: int) -> list[tuple[int, list[int], int]]:
    """Partitions as (number, bits, threshold), from counts over all fingerprints.

    Bit correlations and the collisions of each partition of each candidate cut are exact
    sums over all distinct fingerprints, made by partial aggregation; a few hundred numbers reach the driver.
    """

    # A sum of 64 x 64 products in each task: native code would need 2,080 aggregates.
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        together, ones, n = np.zeros((64, 64)), np.zeros(64), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            together += bits.T @ bits
            ones += bits.sum(0)
            n += len(bits)
        yield pd.DataFrame({"row": range(64), "sums": list(together), "own": ones, "n": n})

    sums = distinct.select("fp").mapInPandas(products, "row int, sums array<double>, own double, n long")
    sums = sums.groupBy("row").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(64)], F.sum("own").alias("own"), F.sum("n").alias("n"))
    rows = sorted(sums.collect(), key=lambda r: r["row"])  # 64 rows
    if not rows or not rows[0]["n"]:
        return [(i, bits, 0) for i, bits in enumerate(bit_groups(np.zeros((64, 64)), max_bits + 1))]
    n = rows[0]["n"]
    mean = np.array([r["own"] for r in rows]) / n
    cover = np.array([[r[f"s{i}"] for i in range(64)] for r in rows]) / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(mean * (1 - mean), 1e-9, None))
    correlation = cover / np.outer(spread, spread)
    cuts = [bit_groups(correlation, m) for m in range(1, min(8, max_bits + 1) + 1)]
    numbered = [(m, i, bits) for m, groups in enumerate(cuts) for i, bits in enumerate(groups)]
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _value("fp", bits).alias("v")) for m, i, bits in numbered])
    counts = distinct.select(F.explode(keys).alias("k")).groupBy("k.m", "k.i", "k.v").count()
    pairs = {(r["m"], r["i"]): r["pairs"] for r in counts.groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    options = []
    for m, groups in enumerate(cuts):
        costs = []
        for i, bits in enumerate(groups):
            # Collisions within radius t: as many more as there are values, though never above all pairs.
            row = [0.0]
            for t in range(max_bits + 1):
                values = ball(len(bits), t)
                row.append(LOOKUP_COST * n * values + CANDIDATE_COST * min(pairs[m, i] * values, float(n) * n))
            costs.append(row)
        cost, chosen = allocate(costs, max_bits - len(groups) + 1)
        options.append((cost, [(k, bits, t) for k, (bits, t) in enumerate(zip(groups, chosen)) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _value(column: str, bits: list[int]):
    return F.col(column).bitwiseAND(F.lit(_mask(bits)).cast("long"))


# ------------------------------------------------------------------ links


def _lookups(nodes: DataFrame, parts: list[tuple[int, list[int], int]]) -> DataFrame:
    """A record for each value to look up: key, own (the node's own value, not one near it), and the node."""

    def probe(number: int, bits: list[int], threshold: int):
        flips = [_mask(list(c)) for k in range(threshold + 1) for c in combinations(bits, k)]
        near = lambda flip: F.struct(
            F.xxhash64(F.lit(number), _value("fp", bits).bitwiseXOR(flip)).alias("key"), (flip == 0).alias("own")
        )
        return F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), near)

    probes = [probe(*part) for part in parts]
    return nodes.select(F.explode(F.concat(*probes)).alias("p"), *nodes.columns).select("p.key", "p.own", *nodes.columns)


def _tiled(records: DataFrame, spread_by: str = "fp") -> DataFrame:
    """Records with a unit column: buckets of over TILE records become units of two tiles each.

    Every pair of records of a bucket meets in a unit.  The list of such buckets is short:
    at most max(TILE, total / 200,000) records go undivided, so it has 200,000 rows at most.
    """
    sizes = stage(records.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE), "large-buckets")
    bound = max(TILE, (sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) // 200_000)
    large = sizes.filter(F.col("n") > bound).select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64(spread_by), F.col("tiles")).cast("int")
    joined = records.join(F.broadcast(large), "key", "left").withColumn("tile", F.coalesce(tile, F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1))
    spread = joined.select("*", other.alias("other"))
    return spread.withColumn("unit", F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))).drop("tiles", "tile", "other")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node linked to each of the nodes 0..n-1 under links (a, b); n is a's last value."""
    n, a, b = int(a[-1]), a[:-1], b[:-1]
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        then = root.copy()
        np.minimum.at(then, root[a], low)
        np.minimum.at(then, root[b], low)
        then = then[then]
        if (then == root).all():
            return root
        root = then


def bucket_links(columns: dict[str, np.ndarray], max_bits: int, wide_bits: int) -> np.ndarray:
    """Edges (i, j) of a spanning forest of the links inside each unit; rows come sorted by unit, key."""
    unit, key, own = (columns[c] for c in ("unit", "key", "own"))
    # Unsigned: numpy counts the bits of a negative number's absolute value.
    fp, *wide = (columns[c].view(np.uint64) for c in ("fp", *(("w1", "w2") if wide_bits else ())))
    n = len(unit)
    change = np.flatnonzero((unit[1:] != unit[:-1]) | (key[1:] != key[:-1])) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [n]])
    end_of = np.repeat(ends, ends - starts)
    left, right = [], []
    longest = int((ends - starts).max()) if n else 0
    alive = np.arange(n)
    # Row i with row i + d of the same bucket, for all i at once; own values only look up own or near ones.
    for d in range(1, longest):
        alive = alive[alive + d < end_of[alive]]
        if not len(alive):
            break
        other = alive + d
        close = np.bitwise_count(fp[alive] ^ fp[other]) <= max_bits
        i, j = alive[close], other[close]
        if len(i):
            good = (own[i] | own[j]) & (fp[i] != fp[j]) if not wide_bits else own[i] | own[j]
            if wide_bits:
                apart = sum(np.bitwise_count(w[i] ^ w[j]) for w in wide)
                good &= apart <= wide_bits
            left.append(i[good])
            right.append(j[good])
        if sum(map(len, left)) > 4_000_000:  # keep the forest of what was found so far
            root = forest(np.concatenate([*left, [n]]), np.concatenate([*right, [n]]))
            moved = np.flatnonzero(root != np.arange(n))
            left, right = [moved], [root[moved]]
    if not left:
        return np.zeros((0, 2), np.int64)
    root = forest(np.concatenate([*left, [n]]), np.concatenate([*right, [n]]))
    moved = np.flatnonzero(root != np.arange(n))
    return np.stack([moved, root[moved]], 1)


def links(nodes: DataFrame, max_bits: int, wide_bits: int = 0) -> DataFrame:
    """Edges a, b between node ids that keep every link's connection.

    ``nodes`` (staged, distinct) has id, fp and, for ``wide_bits``, w1 and w2, whose 128 bits may then
    differ in at most ``wide_bits``.
    """
    wide = ["w1", "w2"] if wide_bits else []
    parts = plan(nodes.select("fp"), max_bits)
    records = _tiled(_lookups(nodes.select("id", "fp", *wide), parts))
    dealt = records.repartition(partitions(nodes.sparkSession), "unit").sortWithinPartitions("unit", "key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            columns = {c: rows[c].to_numpy() for c in ("unit", "key", "own", "fp", "id", *wide)}
            edges = bucket_links(columns, max_bits, wide_bits)
            pairs = columns["id"][edges]
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}).drop_duplicates()

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = int(np.searchsorted(rows["unit"].to_numpy(), rows["unit"].iat[-1], side="left"))
            # The last unit may go on in the next batch.
            if last:
                yield found(rows.iloc[:last])
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield found(held)

    return dealt.mapInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Null or blank text has fingerprint zero and links like any other; a null doc_id never
    names a component unless no member has an id; repeated rows share a row's
    results; an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(fingerprints(plain, words).select("doc_id", "fp"), "fingerprints")
    groups = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    nodes = groups.select(F.col("fp").alias("id"), "fp")
    found = components(links(nodes, max_bits))
    least = _component_ids(groups, found)
    rows = rows.withColumn("_fp", F.hex("fp"))
    out = attach(rows, least.withColumn("_fp", F.hex("fp")), "_fp", "n", ["component_id"], F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    return out.select("doc_id", F.lower(F.lpad(F.col("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_ids(groups: DataFrame, found: DataFrame) -> DataFrame:
    """fp, n, component_id of every distinct fingerprint."""
    named = groups.join(found, groups["fp"] == found["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum(F.lit(1)).alias("members"))
    many = stage(ids, "component-ids")
    keyed = named.withColumn("_root", F.hex("root"))
    out = attach(keyed, many.withColumn("_root", F.hex("root")), "_root", "members", ["component_id"], F.concat(F.lit("fp"), F.hex("fp")))
    return stage(out.select("fp", "n", "component_id"), "fingerprint-components")


# ------------------------------------------------------------------ the near-duplicate stage

#: Documents are near copies if their five-word shingles are similar (Jaccard) by at least so much.
STAGE_WORDS = 5
STAGE_SIMILARITY = 0.8
#: Beside the fingerprints' look-ups, candidates share one of BANDS bands of ROWS minimum hashes: of pairs of similarity 0.8,
#: 1 - (1 - 0.8 ** 4) ** 10 = 0.995 do.  A byte of each of HASHES minima is the sketch that decides.
HASHES, BANDS, ROWS = 256, 10, 4
#: Standard deviations of the sketch's estimate allowed below the similarity, so that few pairs of just that similarity are missed.
SLACK = 1.65


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, np.uint64)


def minima(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each of HASHES functions over the shingles, as unsigned 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 256):
        values = hashes[at : at + 256, None] * factors[0] + factors[1]
        np.minimum(out, (values >> np.uint64(32)).min(0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys ^ rows[:, k])
    return keys


def stage_sketches(docs: DataFrame, words: int = STAGE_WORDS, column: str = "sketch") -> DataFrame:
    """``docs`` with a struct of the SimHash words w1 and w2, the band keys, and the sketch of a text's shingles."""

    @F.pandas_udf("w1 long, w2 long, bands array<long>, bytes binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        factors, rows = _multipliers(), []
        for text in texts:
            own = shingle_hashes(text, words)
            least = minima(own, factors)
            rows.append((_signed(majority(own)), _signed(majority(_mixed(own))), band_keys(least).view(np.int64), least.astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["w1", "w2", "bands", "bytes"])

    return docs.withColumn(column, sketch(text_of()))


def bytes_alike(similarity: float) -> int:
    """Sketch bytes that agree for sets of a Jaccard similarity, less SLACK standard deviations."""
    p = similarity + (1 - similarity) / 256
    return math.ceil(HASHES * p - SLACK * math.sqrt(HASHES * p * (1 - p)))


def similar_forest(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sketches (rows) of which at least ``least`` bytes agree.

    Breadth first: each row reached is held against the rows not reached yet, so a group of near copies of one document
    takes a comparison for each of them, not for each pair.
    """
    rest, out = np.arange(len(sketches)), []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            close = np.concatenate([(sketches[rest[at : at + 4096]] == sketches[one]).sum(1) >= least for at in range(0, len(rest), 4096)])
            found = rest[close].tolist()
            out += [(one, x) for x in found]
            todo += found
            rest = rest[~close]
    return out


def band_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges a, b between similar nodes that share a band; ``nodes`` (staged, distinct) has id, bands and bytes.

    Only keys that several nodes share go on, and only their nodes' sketches move.  A bucket passes on a spanning forest;
    one of over TILE nodes is compared tile by tile, in many tasks.
    """
    keys = nodes.select("id", F.explode("bands").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-bands")
    met = attach(keys, shared, "key", "n", ["n"], F.xxhash64("id", "key")).filter(F.col("n").isNotNull()).select("key", "id")
    records = _tiled(stage(met, "band-records"), "id").join(nodes.select("id", "bytes"), "id")
    dealt = records.select("unit", "id", "bytes").repartition(partitions(nodes.sparkSession), "unit").sortWithinPartitions("unit")
    least = bytes_alike(similarity)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            unit, ids = rows["unit"].to_numpy(), rows["id"].to_numpy()
            sketches = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, HASHES)
            cuts = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]]).tolist()
            pairs = [(a + i, a + j) for a, b in zip(cuts, cuts[1:]) for i, j in similar_forest(sketches[a:b], least)]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]}).drop_duplicates()

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last unit may go on in the next batch.
            last = int(np.searchsorted(rows["unit"].to_numpy(), rows["unit"].iat[-1], side="left")) if len(rows) else 0
            if last:
                yield found(rows.iloc[:last])
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield found(held)

    return dealt.mapInPandas(verify, "a long, b long")


def drop_near(docs: DataFrame, max_bits: int = MAX_BITS, words: int = STAGE_WORDS, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """One document of each near-duplicate group, columns unchanged.

    Groups are the components of two kinds of links: fingerprints of three-word shingles that differ in at most ``max_bits``
    bits, whose 128 SimHash bits of five-word shingles are as close as those of sets of Jaccard similarity ``similarity``
    (one standard deviation allowed); and documents that share a band of minimum hashes of five-word shingles, whose 256-byte
    sketches agree as those of such sets (SLACK standard deviations allowed).  Look-ups and buckets grow with
    the documents, not with their pairs.  The row with the smallest doc_id stays (null ids last); rows equal in id,
    fingerprint and sketch count as one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*columns).alias("_row"))
    sketched = stage_sketches(fingerprints(packed.select("doc_id", "text")), words)
    sketched = sketched.select("doc_id", "fp", "sketch.w1", "sketch.w2", "sketch.bands", "sketch.bytes", F.xxhash64(text_of()).alias("content"))
    rows = stage(sketched.withColumn("id", F.xxhash64("fp", "w1", "w2", "bytes")), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("content").alias("content"))
    groups = rows.groupBy("id").agg(F.min(rank).alias("least"), *[F.first(c).alias(c) for c in ("fp", "w1", "w2", "bands", "bytes")])
    groups = stage(groups, "distinct-sketches")
    found = components(links(groups, max_bits, bits_for(similarity, 128)).unionByName(band_links(groups, similarity)))
    named = groups.join(found, groups["id"] == found["node"], "left").select(F.coalesce("root", "id").alias("root"), "least")
    mark = lambda doc_id, content: F.concat_ws("-", F.coalesce(doc_id.cast("string"), F.lit("none")), F.hex(content))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(mark(F.col("least.doc_id"), F.col("least.content")).alias("_mark"))
    counted = rows.groupBy(mark(F.col("doc_id"), F.col("content")).alias("_mark")).agg(F.count("*").alias("_n"))
    gone = counted.join(kept.withColumn("_kept", F.lit(True)), "_mark", "left").filter(F.col("_kept").isNull() | (F.col("_n") > 1))
    # Few rows go, or repeat (equal in id and text: one stays); the others are not moved.
    gone = stage(gone.select("_mark", F.col("_kept").isNotNull().alias("_repeated")), "near-copies")
    marked = suspected(packed.withColumn("_mark", mark(F.col("doc_id"), F.xxhash64(text_of()))), gone, "_mark", "_near")
    looked = marked.filter("_near").join(gone, "_mark", "left").filter(F.coalesce("_repeated", F.lit(True)))
    own = F.when(F.col("_repeated").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    once = looked.withColumn("_own", own).dropDuplicates(["_mark", "_own"])
    return marked.filter(~F.col("_near")).select("_row.*").unionByName(once.select("_row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
