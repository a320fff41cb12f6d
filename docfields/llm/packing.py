"""Variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted length. Pieces are dealt by a digest of id and piece number into
shards of about ``SHARD_PIECES``, and each shard is packed by itself: only lengths travel, never texts, and the waste
of a shard's last bins is one part in thousands.

Within a shard, pieces come in descending length. A piece goes to the open bin that it fills best. If none has
room, a bin of the least-cost size is opened: of the permitted lengths that hold the piece, the one with the least
cost per word of what it can be expected to hold, namely the piece and what later pieces can put into the rest.
Finally every bin is downsized to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import ship, stored, word_count, words

CAPACITIES = (512, 1024, 2048, 4096)
# What a bin costs beside its length, in words.
BIN_COST = 32
SHARD_PIECES = 16_384


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, bin_cost: float = BIN_COST) -> list[tuple[int, int, int]]:
    """(bin, size of the bin, start within it) for every piece; ``lengths`` are positive and descending.

    Open bins are stacks by free room; one bit for each room that has a bin finds the smallest sufficient one.
    """
    sizes = sorted(capacities)
    after = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        after[i] = after[i + 1] + lengths[i]
    descending = [-n for n in lengths]
    stacks: dict[int, list[int]] = {}
    rooms = 0
    filled: list[int] = []
    placed: list[tuple[int, int]] = []
    for i, length in enumerate(lengths):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            def price(size: int, length: int = length, i: int = i) -> float:
                rest = size - length
                later = after[max(i + 1, bisect_left(descending, -rest))] if rest else 0
                return (size + bin_cost) / (length + min(rest, later))

            room = min((s for s in sizes if s >= length), key=lambda s: (price(s), s))
            at = len(filled)
            filled.append(0)
        placed.append((at, filled[at]))
        filled[at] += length
        room -= length
        if room:
            stacks.setdefault(room, []).append(at)
            rooms |= 1 << room
    return [(at, sizes[bisect_left(sizes, filled[at])], start) for at, start in placed]


def pieces(documents: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """doc_id, piece (from 0), first_word, length of every piece, and its shuffling digest."""
    largest = max(capacities)
    sized = documents.select("doc_id", length.cast("long").alias("words")).filter(F.col("words") > 0)
    return sized.select(
        "doc_id", "words", F.explode(F.sequence(F.lit(0), F.expr(f"(words - 1) div {largest}"))).alias("piece")
    ).select(
        "doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * largest).cast("long").alias("first_word"),
        F.least(F.lit(largest), F.col("words") - F.col("piece") * largest).cast("int").alias("length"),
        F.xxhash64(F.lit("packing"), F.col("doc_id").cast("string"), F.col("piece"), F.col("words")).alias("digest"),
    )


def pack_documents(
    documents: DataFrame,
    length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    bin_cost: float = BIN_COST,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """The place of every piece: doc_id, piece, first_word, length, shard, bin, bin_size, start.

    ``length`` (over the columns of ``documents``) defaults to the words of column text. (shard, bin) names a bin; the piece
    covers ``start`` to ``start + length`` of it. Null, empty and blank texts have no piece; a text longer than the
    largest capacity has several; repeated rows are packed as often as they occur, equal lengths in the order of
    their digests; other columns are not read. No rows give no rows.
    """
    cut = stored(pieces(documents, word_count(F.col("text")) if length is None else length, capacities), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "digest", "doc_id", "piece"], ascending=[False, True, True, True], ignore_index=True)
        found = pack(shard["length"].tolist(), capacities, bin_cost)
        columns = dict(zip(("bin", "bin_size", "start"), map(list, zip(*found, strict=True)), strict=True))
        return shard.drop(columns=["digest"]).assign(**columns)

    columns = ("doc_id", "piece", "first_word", "length", "shard", "bin", "bin_size", "start")
    return (
        cut.withColumn("shard", F.pmod(F.col("digest"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(run, f"doc_id {kind}, piece long, first_word long, length int, shard long, bin long, bin_size int, start int")
        .select(*columns)
    )


def piece_text(text: Column, first_word: Column, length: Column) -> Column:
    """The words of a piece, joined with single spaces."""
    return F.array_join(F.slice(words(text), first_word.cast("int") + 1, length.cast("int")), " ")


