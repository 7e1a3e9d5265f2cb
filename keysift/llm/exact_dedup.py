"""Exact deduplication: radix tries own the texts of a length-and-hash partition.

Texts are compared after white space is deleted.  Each map task puts the full byte strings it reads
into a radix trie and passes on one record per distinct text; owners of a (length,
hash) partition merge the records of all tasks in a trie of their own, whose terminal nodes
hold the row that stays.  A trie over its byte budget gives off its largest subtree: on the
map side into the shuffle, whose owners merge it again; owners read their records
in (length, hash) order, so between two of these all subtrees are finished and may go into the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import attach, partitions, stage, suspected, table, text_of

#: Bytes a trie holds, nodes included, before it gives off a subtree; in a map task, and at an owner.
TRIE_BYTES = 64 << 20
OWNER_BYTES = 32 << 20
#: Bytes of a node besides its edge: the object, its dictionary of children, its terminal.
NODE_BYTES = 400

RECORD = "length long, hash long, content binary, chars long, id long, n_best long, n long"


class Node:
    __slots__ = ("edge", "children", "terminal")

    def __init__(self, edge: bytes, terminal: tuple | None = None) -> None:
        self.edge, self.children, self.terminal = edge, {}, terminal


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id, rows tied at these, rows): the row that stays, counts added up."""
    rank = [(-x[0], x[1] is None, x[1] or 0) for x in (a, b)]
    if rank[0] == rank[1]:
        return (a[0], a[1], a[2] + b[2], a[3] + b[3])
    first = a if rank[0] < rank[1] else b
    return (first[0], first[1], first[2], a[3] + b[3])


class RadixTrie:
    """A compressed (Patricia) trie of byte strings."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, terminal: tuple) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.terminal = better(node.terminal, terminal) if node.terminal else terminal
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], terminal)
                self.held += len(key) - at + NODE_BYTES
                return
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            # First byte that differs, by halves: slices compare at memory speed.
            low, high = 1, min(len(edge), len(key) - at)
            while low < high:
                middle = (low + high + 1) // 2
                if edge[:middle] == key[at : at + middle]:
                    low = middle
                else:
                    high = middle - 1
            upper = Node(edge[:low])
            self.held += NODE_BYTES
            child.edge = edge[low:]
            upper.children[child.edge[0]] = child
            node.children[key[at]] = upper
            node, at = upper, at + low

    def items(self, below: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple]]:
        todo = [(below or self.root, prefix)]
        while todo:
            node, above = todo.pop()
            key = above + node.edge
            if node.terminal:
                yield key, node.terminal
            todo.extend((child, key) for child in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, tuple]]:
        """Take off the largest subtree below the root and give its entries."""
        sizes = {first: sum(len(n.edge) + NODE_BYTES for n in self.nodes(child)) for first, child in self.root.children.items()}
        first = max(sizes, key=sizes.get)
        child = self.root.children.pop(first)
        self.held -= sizes[first]
        yield from self.items(child)

    @staticmethod
    def nodes(top: Node) -> Iterator[Node]:
        todo = [top]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(node.children.values())


def _frames(entries: Iterator[tuple], columns: list[str], size: int) -> Iterator[pd.DataFrame]:
    """Entries as frames of about 4 MB of content."""
    rows, held = [], 0
    for entry in entries:
        rows.append(entry)
        held += len(entry[size]) + 64
        if held > 4 << 20:
            yield _typed(pd.DataFrame(rows, columns=columns))
            rows, held = [], 0
    if rows:
        yield _typed(pd.DataFrame(rows, columns=columns))


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(id=frame["id"].astype("Int64"))


def _ids(series: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in series] if series.isna().any() else series.astype("int64").tolist()


def local_tries(batches: Iterator[pd.DataFrame], budget: int = TRIE_BYTES) -> Iterator[pd.DataFrame]:
    """One record per distinct text of a map task (more where a subtree went early)."""
    from xxhash import xxh64_intdigest

    def entry(key: bytes, t: tuple) -> tuple:
        return (len(key), xxh64_intdigest(key) - (1 << 63), key, *t)

    def entries() -> Iterator[tuple]:
        trie = RadixTrie()
        for batch in batches:
            for key, chars, doc_id in zip(batch["content"], batch["chars"].tolist(), _ids(batch["id"])):
                trie.insert(bytes(key), (chars, doc_id, 1, 1))
                while trie.held > budget:
                    yield from (entry(*x) for x in trie.spill())
        yield from (entry(*x) for x in trie.items())

    return _frames(entries(), RECORD_COLUMNS, 2)


RECORD_COLUMNS = ["length", "hash", "content", "chars", "id", "n_best", "n"]
GROUP = "text_sha256 string, chars long, id long, n_best long, n long"
GROUP_COLUMNS = ["text_sha256", "chars", "id", "n_best", "n"]


def owner_tries(batches: Iterator[pd.DataFrame], budget: int = OWNER_BYTES) -> Iterator[pd.DataFrame]:
    """Merge the records of a partition, which come in (length, hash) order, in one trie.

    The trie owns a range of (length, hash).  When the next one of these begins, all its texts are complete, and
    subtrees leave memory until it is within its budget.
    """
    from hashlib import sha256

    def entries() -> Iterator[tuple]:
        trie, current = RadixTrie(), None
        for batch in batches:
            columns = [batch[c].tolist() for c in ("length", "hash", "content", "chars")]
            for length, code, content, chars, doc_id, best, n in zip(
                *columns, _ids(batch["id"]), batch["n_best"].tolist(), batch["n"].tolist()
            ):
                if (length, code) != current:
                    current = (length, code)
                    while trie.held > budget:
                        yield from ((sha256(key).hexdigest(), *t) for key, t in trie.spill())
                trie.insert(bytes(content), (chars, doc_id, best, n))
        yield from ((sha256(key).hexdigest(), *t) for key, t in trie.items())

    return _frames(entries(), GROUP_COLUMNS, 0)


def normalised(column: Column) -> Column:
    """Without the characters space and \\x09-\\x0D."""
    return F.regexp_replace(column, "[\\x20\\x09-\\x0D]+", "")


def groups_of(docs: DataFrame) -> DataFrame:
    """A row per distinct normalised text: its SHA-256, the row that stays, rows tied with it, group size."""
    content = normalised(text_of()).cast("binary")
    rows = docs.select(content.alias("content"), F.length(text_of()).cast("long").alias("chars"), F.col("doc_id").cast("long").alias("id"))
    records = rows.mapInPandas(local_tries, RECORD)
    dealt = records.repartition(partitions(docs.sparkSession), "length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInPandas(owner_tries, GROUP)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_best.

    Null text counts as empty; all texts without a visible character are equal.  Of equal texts
    the one with the most code points stays, then the one with the smallest id;
    a null id comes after all others.  Repeated rows that tie in both count as one
    document: each is ``kept``, and ``n_best`` says how many there are.
    An empty table gives no rows; other columns are ignored.
    """
    rows, groups = _rows_and_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    out = attach(rows, groups, "text_sha256", "n", ["id", "best_chars", "n_best", "n"], F.col("doc_id"))
    return out.select("doc_id", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), _kept().alias("kept"), "text_sha256", "n_best")


def _rows_and_groups(docs: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    groups = stage(groups_of(docs), "exact-groups").withColumnRenamed("chars", "best_chars")
    rows = docs.select(
        "doc_id",
        *extra,
        F.length(text_of()).cast("long").alias("chars"),
        F.sha2(normalised(text_of()).cast("binary"), 256).alias("text_sha256"),
    )
    return rows, groups


def _kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("chars") == F.col("best_chars"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, columns unchanged; of rows that tie, any one."""
    if "text" not in docs.columns:
        raise ValueError("documents need a text column")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    groups = stage(groups_of(packed), "exact-groups").withColumnRenamed("chars", "best_chars")
    rows = packed.select("doc_id", "_row", F.length(text_of()).cast("long").alias("chars"), F.sha2(normalised(text_of()).cast("binary"), 256).alias("text_sha256"))
    # Only texts with copies need a look at their group: other rows stay where they are.
    copied = groups.filter(F.col("n") > 1).select("text_sha256", "id", "best_chars", "n_best", "n")
    marked = suspected(rows, copied, "text_sha256", "_copied")
    joined = attach(
        marked.filter("_copied").drop("_copied"), copied, "text_sha256", "n", ["id", "best_chars", "n_best", "n"], F.col("doc_id")
    )
    single = F.col("n").isNull()
    # Rows that tie are equal in id and text; ``tie`` is their text, and each other row has its own.
    tie = F.when(~single & (F.col("n_best") > 1), F.col("text_sha256")).otherwise(F.concat_ws("-", "doc_id", "text_sha256", F.monotonically_increasing_id()))
    kept = joined.filter(single | _kept()).withColumn("_tie", tie).dropDuplicates(["_tie"])
    return marked.filter(~F.col("_copied")).select("_row.*").unionByName(kept.select("_row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: Equal to op3_exact_dedup for tables without repeated rows.
ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256,
       CAST(1 AS BIGINT) AS n_best FROM r
"""
