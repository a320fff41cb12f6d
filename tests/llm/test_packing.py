import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docfields.llm import packing
from tests_llm_help import prose, rows_of


def slow_pack(lengths, capacities, bin_cost):
    """Best fit by trying every bin."""
    bins, placed = [], []
    for i, length in enumerate(lengths):
        open_bins = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= length]
        if open_bins:
            rooms = {bins[b][0] - bins[b][1] for b in open_bins}
            best = [b for b in open_bins if bins[b][0] - bins[b][1] == min(rooms)]
            at = max(best, key=lambda b: bins[b][2])
        else:
            def price(size):
                rest = size - length
                later = sum(n for n in lengths[i + 1 :] if n <= rest)
                return (size + bin_cost) / (length + min(rest, later)), size

            size = min((c for c in capacities if c >= length), key=price)
            bins.append([size, 0, 0])
            at = len(bins) - 1
        placed.append((at, bins[at][1]))
        bins[at][1] += length
        bins[at][2] = i + 1  # the bin that was filled to this room last is on top
    return [(at, min(c for c in capacities if c >= bins[at][1]), start) for at, start in placed]


@pytest.mark.parametrize("seed", range(12))
def test_pack_equals_brute_force(seed):
    chooser = random.Random(seed)
    capacities = chooser.choice([(16,), (8, 16, 32), (5, 9, 33)])
    lengths = sorted((chooser.randrange(1, max(capacities) + 1) for _ in range(chooser.randrange(1, 120))), reverse=True)
    assert packing.pack(lengths, capacities, 2) == slow_pack(lengths, capacities, 2)


def check_bins(rows, capacities):
    bins = defaultdict(list)
    for r in rows:
        bins[r.shard, r.bin].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.start)
        at = 0
        for r in members:
            assert r.start == at
            at += r.length
        assert {r.bin_size for r in members} == {min(c for c in capacities if c >= at)}
    return bins


def test_every_word_is_packed_once(spark):
    rows = [(i, prose(i, (i * 37) % 700)) for i in range(400)] + [(1000, prose(1, 9001)), (1001, prose(2, 8192))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack_documents(table, shard_pieces=100).collect()
    words = defaultdict(list)
    for r in found:
        words[r.doc_id].append((r.piece, r.first_word, r.length))
    for doc_id, text in rows:
        at = 0
        for n, (piece, first, length) in enumerate(sorted(words.get(doc_id, []))):
            assert (piece, first) == (n, at)
            at += length
        assert at == len(text.split())
    bins = check_bins(found, packing.CAPACITIES)
    assert sum(r.length for r in found) / sum(m[0].bin_size for m in bins.values()) > 0.9


def test_text_of_a_piece(spark):
    table = spark.createDataFrame([(1, "a  b\nc d e", 2, 2)], "doc_id long, text string, first_word long, length int")
    assert table.select(packing.piece_text(F.col("text"), F.col("first_word"), F.col("length"))).first()[0] == "c d"


def test_odd_rows(odd, clashing, nothing):
    found = packing.pack_documents(odd)
    assert rows_of(found) == rows_of(packing.pack_documents(clashing)) == rows_of(packing.pack_documents(odd))
    assert packing.pack_documents(nothing).count() == 0
    rows = found.collect()
    check_bins(rows, packing.CAPACITIES)
    assert sum(r.length for r in rows if r.doc_id == 6) == 30_000
    assert {r.doc_id for r in rows} == {None, 4, 5, 6, 7, 8}
    assert sum(r.doc_id == 4 for r in rows) == 2
