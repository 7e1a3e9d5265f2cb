"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every run of SEED_WORDS words of a test item is a possible seed; of an item of fewer than SHORT words, every word.  One pass
over the corpus counts the documents of each; an item keeps its rarer ones.  A second pass finds the kept seeds in
the documents, and around them aligns the item's words with the document's:
a local alignment score close to the item's own is a copy, edited or paraphrased
in places.  Documents stay where they are; only hits are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import stage, suspected, table, text_of

SEED_WORDS = 3
#: Share of an item's seeds that are kept, rarest first (all that tie with the last one kept).
RARE_SHARE = 0.9
#: Edits leave too few whole runs of shorter items.  Of these a copy has at least the threshold's share of words, so it has
#: one of the others' number and one more: that many, the rarest, are seeds, and none is missed.
SHORT = 12
#: A passage is a copy if its alignment score is at least so much of the item's alignment with itself.
THRESHOLD = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of so many words in all are handed to the tasks at a time (some 50 bytes a word); a larger benchmark is searched in
#: blocks, each in two passes over the corpus and gone before the next one comes.
BLOCK_WORDS = 1_000_000
MATCHES = "doc_id long, item_id long, score double, first_word long, last_word long"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: letters, digits and what is not ASCII; other characters part them."""
    return text.lower().encode().translate(_WORD_BYTES).split()


_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def word_codes(text: str) -> np.ndarray:
    """A 64-bit code per word, from hashes at word ends; equal words have equal codes."""
    raw = np.frombuffer(text.lower().encode().translate(_WORD_BYTES) + b" ", np.uint8)
    inside = raw != 0x20
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
    # A polynomial of the bytes, as a difference of running sums, shifted to the word's start.
    powers, inverse = _powers(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
    codes = (sums[ends] - sums[starts]) * inverse[starts]
    codes ^= codes >> np.uint64(29)
    return codes * MULTIPLIER + (ends - starts).astype(np.uint64)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_codes(codes: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """A code per run of n words; of fewer words, one code for the whole sequence; of none, none."""
    if not len(codes):
        return codes
    n = min(n, len(codes))
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ codes[i : len(codes) - n + 1 + i]) * MULTIPLIER
        out ^= out >> np.uint64(31)
    return out


def seed_words(words: np.ndarray) -> int:
    """Words in a seed of an item."""
    return 1 if len(words) < SHORT else SEED_WORDS


class Seeds:
    """Items of a block: word codes, and the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rare: list[np.ndarray] | None = None) -> None:
        self.items = items
        codes, owners, places = [], [], []
        for k, (_, words) in enumerate(items):
            grams = gram_codes(words, seed_words(words))
            at = np.arange(len(grams)) if rare is None else rare[k]
            codes.append(grams[at])
            owners.append(np.full(len(at), k))
            places.append(at)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(self.codes, kind="stable")
        self.codes = self.codes[order]
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.distinct = np.unique(self.codes)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.distinct >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = sorted({seed_words(w) for _, w in items})

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a document that are seeds, and their places."""
        found, at = [], []
        for n in self.sizes:
            if len(words) < n:
                continue
            codes = gram_codes(words, n)
            likely = np.flatnonzero(self.sieve[(codes >> np.uint64(44)).astype(np.int64)])
            k = np.searchsorted(self.distinct, codes[likely])
            good = likely[(k < len(self.distinct)) & (self.distinct[np.minimum(k, len(self.distinct) - 1)] == codes[likely])] if len(self.distinct) else likely[:0]
            found.append(codes[good])
            at.append(good)
        return (np.concatenate(found), np.concatenate(at)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of two word sequences: score, and the first and last place in b of the alignment."""
    best = (0, 0, -1)
    above, start_above = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    lanes = np.arange(len(b) + 1)
    for word in a:
        same = np.where(b == word, MATCH, MISMATCH)
        cell, start = np.zeros(len(b) + 1, np.int64), lanes.copy()
        diagonal, up = above[:-1] + same, above[1:] + GAP
        take = diagonal >= up
        value = np.where(take, diagonal, up)
        origin = np.where(take, start_above[:-1], start_above[1:])
        alive = value > 0
        cell[1:] = np.where(alive, value, 0)
        start[1:] = np.where(alive, origin, lanes[1:])
        # Gaps along the row: the running maximum of the cells less the distance.
        shifted = cell - GAP * lanes
        reach = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == reach, lanes, 0))
        cell, start = reach + GAP * lanes, start[source]
        end = int(cell.argmax())
        if cell[end] > best[0]:
            best = (int(cell[end]), int(start[end]), end - 1)
        above, start_above = cell, start
    return best


def matches_in(words: np.ndarray, seeds: Seeds, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item number, score, first word, last word) of the best copy of each item in a document."""
    codes, at = seeds.grams(words)
    if not len(codes):
        return []
    low, high = np.searchsorted(seeds.codes, codes, "left"), np.searchsorted(seeds.codes, codes, "right")
    hit = np.repeat(np.arange(len(codes)), high - low)
    slot = np.concatenate([np.arange(x, y) for x, y in zip(low, high)])
    owner, begin = seeds.owners[slot], at[hit] - seeds.places[slot]
    out = []
    for k in np.unique(owner):
        own = seeds.items[k][1]
        # A copy has no more inserted words than its score allows, so it begins and ends at most so far from where it would.
        margin = int(np.ceil(2 * (1 - threshold) * len(own))) + 1
        # Windows around where the item would begin; those that overlap become one.
        begins = np.unique(begin[owner == k])
        breaks = np.flatnonzero(np.diff(begins) > margin) + 1
        best = (0.0, 0, 0)
        for group in np.split(begins, breaks):
            first = max(0, int(group[0]) - margin)
            last = min(len(words), int(group[-1]) + len(own) + margin)
            # No alignment can score above the words in common.
            common = int(np.isin(own, words[first:last]).sum())
            if common < threshold * len(own):
                continue
            score, a, b = align(own, words[first:last])
            if score / (MATCH * len(own)) > best[0]:
                best = (score / (MATCH * len(own)), first + a, first + b)
        if best[0] >= threshold:
            out.append((int(k), *best))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The test items in blocks of bounded size; a null or wordless text has no copies and is left out."""
    # The corpus is what grows; the benchmark comes to the driver a partition at a time.
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).toLocalIterator():
        words = word_codes(row["text"])
        if len(words):
            block.append((row["item_id"], words))
            held += len(words)
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def rare_seeds(docs: DataFrame, items: list[tuple[int, np.ndarray]], share: float = RARE_SHARE, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """Places of the seeds each item keeps, by the number of documents (all of them) that have each."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Seeds(shared.value)
        totals = np.zeros(len(seeds.distinct), np.int64)
        for batch in batches:
            for text in batch["text"]:
                codes = np.unique(seeds.grams(word_codes(text))[0])
                totals[np.searchsorted(seeds.distinct, codes)] += 1
        seen = np.flatnonzero(totals)
        yield pd.DataFrame({"code": seeds.distinct[seen].view(np.int64), "n": totals[seen]})

    counts = docs.select(text_of().alias("text")).mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most a row for each seed of the block
    shared.destroy()
    order = np.argsort(found["code"].to_numpy(np.int64).view(np.uint64))
    codes, n = found["code"].to_numpy(np.int64).view(np.uint64)[order], found["n"].to_numpy(np.int64)[order]
    out = []
    for _, words in items:
        grams = gram_codes(words, seed_words(words))
        own = np.zeros(len(grams), np.int64)
        if len(codes):
            at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
            own = np.where(codes[at] == grams, n[at], 0)
        if len(words) < SHORT:
            kept = len(words) - int(np.ceil(threshold * len(words) - 1e-9)) + 1
            out.append(np.sort(np.argsort(own, kind="stable")[:kept]))
        else:
            last = np.sort(own)[int(np.ceil(share * len(own))) - 1]
            out.append(np.flatnonzero(own <= last))
    return out


def _by_block(docs: DataFrame, items: DataFrame, threshold: float, search: Callable[[object], DataFrame], name: str) -> list[DataFrame]:
    """``search(shared items and seeds)`` for each block.

    Of several blocks each result is written before the next block comes, so one block at a time is held, by the driver and the tasks.
    """
    blocks = _blocks(items)
    block, out = next(blocks, None), []
    while block is not None:
        then = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast((block, rare_seeds(docs, block, threshold=threshold)))
        found = search(shared)
        if then is not None or out:
            found = stage(found, name)
            shared.destroy()
        out.append(found)
        block = then
    return out


def find_copies(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Copies of test items in documents: doc_id, item_id, score, first_word, last_word.

    One row per document and item whose best alignment scores at least ``threshold``
    of the item's own; words count from 0.  Null or wordless text on either side
    has no copies; null ids stay null; repeated rows or items give a row each; empty tables give no rows;
    other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def search(shared) -> DataFrame:
        def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, rare = shared.value
            seeds = Seeds(block, rare)
            for batch in batches:
                rows = [
                    (doc_id, block[k][0], score, first, last)
                    for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"])
                    for k, score, first, last in matches_in(word_codes(text), seeds, threshold)
                ]
                found = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word"])
                yield found.assign(doc_id=found["doc_id"].astype("Int64"), item_id=found["item_id"].astype("Int64"))

        return plain.mapInPandas(aligned, MATCHES)

    out = plain.sparkSession.createDataFrame([], MATCHES)
    for found in _by_block(plain, items, threshold, search, "copies"):
        out = out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a copy of a test item, columns unchanged.

    One block of items is a filter, and nothing moves.  Of several blocks each gives the hashes of the texts with a copy; then only
    documents that a bitmap takes for such are shuffled.
    """
    blocks = _blocks(items)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast((first, rare_seeds(docs, first, threshold=threshold)))
        return docs.filter(~_copied(shared, threshold)(text_of()))
    packed = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    mark = F.sha2(text_of().cast("binary"), 256)
    gone = None
    for found in _by_block(docs, items, threshold, lambda shared: packed.filter(_copied(shared, threshold)(text_of())).select(mark.alias("_mark")).distinct(), "contaminated"):
        gone = found if gone is None else gone.unionByName(found)
    marked = suspected(packed.withColumn("_mark", mark), gone, "_mark", "_hit")
    rest = marked.filter("_hit").join(gone.distinct(), "_mark", "left_anti")
    return marked.filter(~F.col("_hit")).select("_row.*").unionByName(rest.select("_row.*"))


def _copied(shared, threshold: float):
    """Whether a text has a copy of an item of the block."""

    @F.pandas_udf("boolean")
    def copied(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = Seeds(*shared.value)
        for texts in batches:
            yield pd.Series([bool(matches_in(word_codes(t), seeds, threshold)) for t in texts], dtype=bool)

    return copied


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
