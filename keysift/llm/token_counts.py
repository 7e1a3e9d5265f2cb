"""Token counts under edits.

The pre-tokens of a document are the leaves of a segment tree whose nodes hold character and token sums.
An edit is found by descending along character sums; only the pre-tokens it touches and the
boundary context around them are cut and encoded again, and the sums on the way up change.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import WordCache, table, text_of
from keysift.llm.packing import vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf when the tree is built.
LEAF = 32
#: Characters behind a pre-token that the pattern looks at: two, as in ' before ll.
AHEAD = 2

COUNTS = "doc_id long, n_edits long, tokens_before long, tokens_after long, chars_after long, chars_encoded long"


@cache
def _tools(path: str):
    """The pre-token pattern, and the token count of a pre-token."""
    import base64

    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(public_tokenizers.PATTERN), WordCache(lambda word: len(encoding.encode_ordinary(word)))


class SegmentTree:
    """Character and token sums over blocks of pre-tokens.

    A block is a list of pre-tokens; the number of blocks is fixed, their content is not.
    """

    def __init__(self, text: str, path: str) -> None:
        self.pattern, self.count = _tools(path)
        found = self.pattern.findall(text)
        self.blocks = [found[i : i + LEAF] for i in range(0, len(found), LEAF)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        # sums[k] is node k: the children of k are 2k and 2k + 1, leaves begin at ``size``.
        self.chars = np.zeros(2 * self.size, np.int64)
        self.tokens = np.zeros(2 * self.size, np.int64)
        n = self.size
        self.chars[n : n + len(self.blocks)] = [sum(map(len, b)) for b in self.blocks]
        self.tokens[n : n + len(self.blocks)] = [sum(map(self.count.__getitem__, b)) for b in self.blocks]
        while n > 1:
            for sums in (self.chars, self.tokens):
                sums[n // 2 : n] = sums[n : 2 * n].reshape(-1, 2).sum(1)
            n //= 2
        self.encoded = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def locate(self, place: int) -> tuple[int, int]:
        """Block that holds the character ``place``, or the last one, and where the block begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place >= begin + self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return min(node - self.size, len(self.blocks) - 1), begin if node - self.size < len(self.blocks) else int(self.chars[1] - self.chars[self.size + len(self.blocks) - 1])

    def _update(self, block: int) -> None:
        node = self.size + block
        self.chars[node] = sum(map(len, self.blocks[block]))
        self.tokens[node] = sum(map(self.count.__getitem__, self.blocks[block]))
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters start..end (end exclusive) by ``new``.

        Pre-tokens are cut from left to right, and one depends on its own characters and the AHEAD next ones
        only.  So those that end more than that before ``start`` stay; cutting begins with the next one,
        and goes on until a cut meets an old boundary at or behind ``end``.
        """
        end = min(max(start, end), int(self.chars[1]))
        start = min(start, end)
        first, begin = self.locate(max(0, start - AHEAD))
        kept: list[str] = []
        for piece in self.blocks[first]:
            if begin + len(piece) > start - AHEAD:
                break
            kept.append(piece)
            begin += len(piece)
        # Old pre-tokens from there on, block by block, as far as the cutting goes.
        block, inside, at = first, len(kept), begin
        region, bounds = [], []  # old text from ``begin``; old ends in it, and (block, next index) of each

        def more() -> bool:
            nonlocal block, inside, at
            while block < len(self.blocks) and inside >= len(self.blocks[block]):
                block, inside = block + 1, 0
            if block >= len(self.blocks):
                return False
            piece = self.blocks[block][inside]
            inside += 1
            at += len(piece)
            region.append(piece)
            bounds.append((at, block, inside))
            return True

        while at < end and more():
            pass
        while True:
            # Context behind the edit; if no cut meets an old boundary in it, take twice as much.
            extra = max(4, len(bounds))
            ended = not all([more() for _ in range(extra)])
            old = "".join(region)
            text = old[: start - begin] + new + old[end - begin :]
            shift = len(new) - (end - start)
            ends = {b[0] + shift: b for b in bounds if b[0] >= end}
            pieces, place, met = [], begin, None
            for match in self.pattern.finditer(text):
                pieces.append(match.group())
                place = begin + match.end()
                # The last cuts may lean on text that is not in the region.
                if place in ends and (ended or match.end() + AHEAD <= len(text)):
                    met = ends[place]
                    break
            if met or ended:
                break
        self.encoded += sum(map(len, pieces))
        if met is None:
            last, tail = len(self.blocks) - 1, []
        else:
            last, tail = met[1], self.blocks[met[1]][met[2] :]
        if last == first:
            self.blocks[first] = kept + pieces + tail
        else:
            self.blocks[first] = kept + pieces
            for k in range(first + 1, last):
                self.blocks[k] = []
                self._update(k)
            self.blocks[last] = tail
            self._update(last)
        self._update(first)


def count_edited(docs: DataFrame, edits: Column, path: str | None = None) -> DataFrame:
    """Token counts before and after each document's own edits.

    ``edits`` is an array of structs (start, end, new) over the original text, in code points, not
    overlapping; a null array or a null field means no such edit.  They are applied from the last to the first, so
    earlier places stay valid.  Returns doc_id, n_edits, tokens_before, tokens_after, chars_after,
    chars_encoded (characters encoded again).

    Null text counts as empty, with 0 tokens; a null doc_id stays null; repeated rows are counted each;
    an empty table gives no rows; columns of docs that ``edits`` does not use are ignored.
    """
    path = path or vocabulary_path(VOCABULARY)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, starts, ends, news in zip(batch["doc_id"].astype(object), batch["text"], batch["starts"], batch["ends"], batch["news"]):
                tree = SegmentTree(text, path)
                before = tree.total
                for start, end, new in sorted(zip(starts, ends, news), key=lambda e: e[0], reverse=True):
                    tree.edit(int(start), int(end), new)
                rows.append((doc_id, len(starts), before, tree.total, int(tree.chars[1]), tree.encoded))
            out = pd.DataFrame(rows, columns=["doc_id", "n_edits", "tokens_before", "tokens_after", "chars_after", "chars_encoded"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    whole = lambda e: e["start"].isNotNull() & e["end"].isNotNull() & e["new"].isNotNull()
    own = F.coalesce(F.filter(edits, whole), F.array().cast("array<struct<start:bigint,end:bigint,new:string>>"))
    # Plain arrays of plain values: they cross to the workers as they are.
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), own.alias("edits"))
    return plain.select("doc_id", "text", F.col("edits.start").alias("starts"), F.col("edits.end").alias("ends"), F.col("edits.new").alias("news")).mapInPandas(count, COUNTS)


#: The query's edits: long digit runs (numbers of accounts, cards, phones) give way to a mark.
MASKED, MARK = r"[0-9]{4,}", "<number>"


def masking_edits(text: Column) -> Column:
    """Edits that replace every match of MASKED by MARK."""
    from keysift.llm.secrets import spans

    found = spans(text, MASKED, 0, lambda m, g: F.lit(True))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(MARK).alias("new")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    return count_edited(docs, masking_edits(F.col("text")))
