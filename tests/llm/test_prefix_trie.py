import hashlib
import random
import zlib

import pytest

from docfields.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))
    ordered = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, ts in turns.items()}
    convs = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = ordered.get(c - c % 100 if c >= 0 else c - int(__import__("math").fmod(c, 100)), [])
        convs[c] = tuple(base[:h]) + tuple(own[h:])
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for prefix in nodes:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    def subtree(prefix):
        leaves = 0 if children.get(prefix) else 1
        saved = (len(nodes[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0)
        for child in children.get(prefix, []):
            a, b = subtree(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved
    found = []
    for prefix, members in nodes.items():
        leaves, saved = subtree(prefix)
        ends = sorted(c for c in members if len(convs[c]) == len(prefix))
        found.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
                      len(children.get(prefix, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(found, key=repr)


KEYS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def spark_rows(frame):
    return sorted((tuple(r[k] for k in KEYS) for r in prefix_trie.prefix_trie(frame).collect()), key=repr)


def fixture(seed, n):
    chooser = random.Random(seed)
    rows = []
    for conv in chooser.sample(range(0, 450), n):
        for turn in range(chooser.choice([0, 1, 2, 3, 5, 8])):
            rows.append((conv, turn, ["user", "assistant", None][turn % 3], chooser.choice(["hi", "yes", "no", "", None, "ünï 🙂"])))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = fixture(block, 120)
    assert spark_rows(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 1, "user", "a" * 100_000),
            (107, 2, "user", "b"), (100, 0, "user", "a"), (100, 0, "user", "a"), (5, 3, None, "")]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1).alias("keys"))
    assert spark_rows(frame) == brute_force(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
