"""Filling containers: first-fit decreasing with a tournament tree in each of many randomised groups.

A text is as long as its tokens of a public byte-level BPE are many. Texts longer than the capacity, and no others, are cut into
parts of the capacity and a rest. Parts go to groups by a hash of (doc_id, part), which are so many that a
group holds about GROUP_TOKENS tokens: the same mix of lengths in each, few enough rows for one task and so many
containers that the one that stays open at a group's end does not count. Within a group the parts are placed by falling
length into the first container that has room; the tournament tree over the containers' free room finds it in log(n).

Defined cases: null and empty texts are one part without tokens, which takes a place and no room; equal lengths are placed by
doc_id and part; repeated doc_ids are placed as often as they come; no documents give no containers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import materialize

CAPACITY = 2048
GROUP_TOKENS = 4_000_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_encodings: dict[str, object] = {}


def encoding(name: str = VOCABULARY):
    """The tokenizer, read once per Python worker."""
    if name not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def token_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of whole texts."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoding()
        for batch in batches:
            n = [len(own.encode_ordinary(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


class Tournament:
    """Free room of containers 0, 1, ...; the winner of a match is the larger room."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.room = [0, capacity]

    def _double(self) -> None:
        old = self.room[self.leaves :]
        self.leaves *= 2
        self.room = [0] * self.leaves + old + [self.capacity] * len(old)
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """(container, start): the first container with room for ``size``, which is taken."""
        if not 0 <= size <= self.capacity:
            raise ValueError("larger than a container")
        while self.room[1] < size:
            self._double()
        i = 1
        while i < self.leaves:
            i *= 2
            if self.room[i] < size:
                i += 1
        container, start = i - self.leaves, self.capacity - self.room[i]
        self.used = max(self.used, container + 1)
        self.room[i] -= size
        while i > 1:
            i //= 2
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        return container, start


def first_fit(sizes: Sequence[int], capacity: int) -> list[tuple[int, int, int]]:
    """(container, place, start) of each size, in the order given."""
    tree, held, out = Tournament(capacity), [], []
    for size in sizes:
        container, start = tree.place(size)
        held.extend([0] * (tree.used - len(held)))
        out.append((container, held[container], start))
        held[container] += 1
    return out


def pack(counted: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(doc_id, part, container, place, start, n_tokens): part k of a text are its tokens from k * capacity on.

    container is unique over all groups; place counts the parts of a container from 0, start its tokens before the part.
    """
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    last = F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.lit(capacity))).cast("int")
    parts = counted.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("part"), F.col("n_tokens").alias("_all"))
    size = F.least(F.lit(capacity), F.col("_all") - F.col("part") * F.lit(capacity)).cast("bigint")
    grouped = parts.select("doc_id", "part", size.alias("n_tokens"), F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "part"), F.lit(groups)).alias("_group"))

    def fill(table):
        import pyarrow as pa

        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("part", "ascending")])
        group = table.column("_group")[0].as_py()
        placed = first_fit(table.column("n_tokens").to_pylist(), capacity)
        columns = {
            "doc_id": table.column("doc_id"),
            "part": table.column("part"),
            "container": pa.array([(group << 32) + c for c, _, _ in placed], pa.int64()),
            "place": pa.array([p for _, p, _ in placed], pa.int32()),
            "start": pa.array([s for _, _, s in placed], pa.int32()),
            "n_tokens": table.column("n_tokens"),
        }
        return pa.table(columns)

    return grouped.groupBy("_group").applyInArrow(fill, "doc_id bigint, part int, container bigint, place int, start int, n_tokens bigint")


def containers(documents: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Every document with the container and place of each of its parts."""
    return pack(materialize(token_counts(documents), "tokens"), capacity, group_tokens)
