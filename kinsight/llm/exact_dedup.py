"""Exact duplicates by Patricia tries.

Texts are compared after all ASCII white space is deleted. Each task first inserts its own texts into one compressed
radix trie whose terminal nodes keep the best owner and a count, so a text that fills a third of the table leaves a
task as one row. What the tries hold is then partitioned by length and content hash and merged by further tries,
one per (length, hash) pair: full byte strings decide, a hash never does. A trie over its memory limit gives up
whole subtrees; their terminals are partial results that the later trie merges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import remembered, ship, text_or_empty, unused

#: ASCII white space: space and the characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
PARTIAL = "text_bytes long, text_hash long, body binary, keep_chars long, keep_id long, copies long"
CLASSES = "text_sha256 string, keep_chars long, keep_id long, group_size long"


class Owner:
    """The row that stays among equal texts: most code points, then smallest identifier, null identifiers last."""

    __slots__ = ("chars", "copies", "doc_id")

    def __init__(self, chars: int, doc_id: int | None, copies: int):
        self.chars, self.doc_id, self.copies = chars, doc_id, copies

    def add(self, chars: int, doc_id: int | None, copies: int) -> None:
        self.copies += copies
        if (-chars, doc_id is None, doc_id or 0) < (-self.chars, self.doc_id is None, self.doc_id or 0):
            self.chars, self.doc_id = chars, doc_id


class Node:
    __slots__ = ("kids", "label", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.owner = label, owner
        self.kids: dict[int, Node] = {}


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: each step is one comparison of slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


class Patricia:
    """Compressed radix trie over byte strings; ``held`` counts the bytes below each first byte."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), {}

    def insert(self, key: bytes, chars: int, doc_id: int | None, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], Owner(chars, doc_id, copies))
                self.held[key[0]] = self.held.get(key[0], 0) + len(key) - at + 300
                return
            if not key.startswith(kid.label, at):
                shared = common_prefix(kid.label, key[at : at + len(kid.label)])
                upper = Node(kid.label[:shared])
                kid.label = kid.label[shared:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = upper
            node, at = kid, at + len(kid.label)
        if node.owner is None:
            node.owner = Owner(chars, doc_id, copies)
        else:
            node.owner.add(chars, doc_id, copies)

    def terminals(self, first: int | None = None) -> Iterator[tuple[bytes, Owner]]:
        """All (text, owner) pairs, or those of the subtree under one first byte."""
        stack = [(b"", self.root)] if first is None else [(b"", self.root.kids[first])]
        while stack:
            before, node = stack.pop()
            text = before + node.label
            if node.owner:
                yield text, node.owner
            stack.extend((text, kid) for kid in node.kids.values())

    def spill(self, first: int) -> list[tuple[bytes, Owner]]:
        """Give up the subtree under one first byte."""
        found = list(self.terminals(first))
        del self.root.kids[first], self.held[first]
        return found


def _frames(rows: list, columns: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    for i in range(0, len(rows), size):
        yield pd.DataFrame(rows[i : i + size], columns=columns)


def _local_owners(memory: int):
    columns = [c.split()[0] for c in PARTIAL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("exact_dedup")
        trie, hashes = Patricia(), {}

        def rows(found):
            return [(len(t), hashes.pop(t), t, o.chars, o.doc_id, o.copies) for t, o in found]

        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for key, mark, chars, doc_id in zip(batch["body"], batch["text_hash"], batch["n_chars"], ids, strict=True):
                hashes[key] = mark
                trie.insert(key, chars, doc_id, 1)
            while sum(trie.held.values()) > memory:
                yield from _frames(rows(trie.spill(max(trie.held, key=trie.held.get))), columns, 500)
        yield from _frames(rows(trie.terminals()), columns, 500)

    return run


def _merged_owners(memory: int):
    """Rows come sorted by length, hash and text, so all but the newest text of a trie is complete."""
    columns = [c.split()[0] for c in CLASSES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("exact_dedup")
        trie, partition, last, out = Patricia(), None, b"", []

        def rows(found):
            return [(hashlib.sha256(t).hexdigest(), o.chars, o.doc_id, o.copies) for t, o in found]

        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["keep_id"]]
            for size, mark, key, chars, doc_id, copies in zip(
                batch["text_bytes"], batch["text_hash"], batch["body"], batch["keep_chars"], ids, batch["copies"], strict=True
            ):
                if (size, mark) != partition:
                    out += rows(trie.terminals())
                    trie, partition = Patricia(), (size, mark)
                elif sum(trie.held.values()) > memory and key[:1] != last[:1]:
                    for first in list(trie.held):
                        out += rows(trie.spill(first))
                trie.insert(key, chars, doc_id, copies)
                last = key
            yield from _frames(out, columns)
            out = []
        yield from _frames(rows(trie.terminals()), columns)

    return run


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, body): code points of the original text, and the text without ASCII white space."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("original")).select(
        "doc_id",
        F.length("original").cast("long").alias("n_chars"),
        F.translate("original", WHITE, "").alias("body"),
    )


def classes(docs: DataFrame, memory: int = 64 << 20) -> DataFrame:
    """One row per distinct normalised text: its digest, the owner's length and identifier, and how many share it.

    ``memory`` bounds the bytes one task's trie holds; it changes when partial results are passed on, never the
    result. An empty table has no classes; null texts count as empty; null identifiers own a text only where every
    row of the text with as many code points has none.
    """
    ship(docs.sparkSession)
    texts = normalised(docs).select(
        "doc_id", "n_chars", F.xxhash64("body").alias("text_hash"), F.col("body").cast("binary").alias("body")
    )
    local = texts.mapInPandas(_local_owners(memory), PARTIAL)
    dealt = local.repartition("text_bytes", "text_hash").sortWithinPartitions("text_bytes", "text_hash", "body")
    return dealt.mapInPandas(_merged_owners(memory), CLASSES)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Only digests travel to meet their class. Rows that repeat an identifier and a text are told apart by a running
    number, so exactly one row of a class is kept.
    """
    slim = (
        normalised(docs)
        .select("doc_id", "n_chars", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
        .groupBy("text_sha256", "doc_id", "n_chars")
        .agg(F.count("*").alias("times"))
    )
    owner = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return slim.join(classes(docs), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"),
        owner.alias("owner"), "text_sha256",
    ).select("doc_id", "keep_id", "group_size", (F.col("owner") & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: the owner of each distinct text."""
    from pyspark.sql import Window

    sha, chars, key, rank, own_sha, own_chars, keep = unused(docs, "__sha", "__chars", "__id", "__nth", "__own_sha", "__own_chars", "__keep")
    marks = {sha: F.sha2(F.translate(text_or_empty(), WHITE, "").cast("binary"), 256), chars: F.length(text_or_empty()).cast("long")}
    owners = classes(docs).select(
        F.col("text_sha256").alias(own_sha), F.col("keep_chars").alias(own_chars), F.col("keep_id").alias(keep)
    )
    marked = docs.withColumns(marks).withColumn(key, F.col("doc_id").cast("long"))
    same = (F.col(sha) == F.col(own_sha)) & (F.col(chars) == F.col(own_chars)) & F.col(key).eqNullSafe(F.col(keep))
    nth = F.row_number().over(Window.partitionBy(sha, chars, key).orderBy(key))
    found = marked.join(owners, same, "left_semi")
    return found.withColumn(rank, nth).filter(F.col(rank) == 1).select(*docs.columns)
