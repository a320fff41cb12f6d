"""Conversation prefix trie from sorted conversations: sparse-table range minima over their LCPs.

Conversations, as sequences of turn digests (SHA-256 of role and text), are sorted; ``lcp[p]`` is the number of
leading turns position ``p`` shares with ``p - 1`` (-1 at the first). A trie node of depth d is a maximal run of
positions whose turns agree in the first d, so it is the interval around any member where every inner lcp is at
least d. Each candidate (position i, depth d) with ``lcp[i] < d <= turns(i)`` is the leftmost member of its node; a
descent over a sparse table of minima finds the right extent (the first later position with lcp below d), and
another, independent one the left extent of depth d-1 (the parent's first member). No stack is needed, so the
candidates of a block are searched all at once with numpy.

How it is laid out: positions come in blocks of ``BLOCK`` (one small group each, with its own sparse table). A
search that leaves its block first finds the block in which it ends on a sparse table of block minima (one row of
three numbers per block, ``rows / BLOCK`` of them, which is small and broadcast), then asks that block, one question
per (block, depth, side) however many nodes ask it. Subtree sums (leaves, saved tokens) are differences of prefix
sums over positions, which Spark builds per block plus block offsets. The digest of a node's ending members is a
sequential hash by definition; copies of one conversation are hashed in one task while streaming, never held.

Odd input: rows with a null ``conv_id`` belong to no conversation and are left out; null turns come first and ties
in ``turn`` are ordered by role and text; null roles and texts are empty; conversations whose rebuilt form has no
turns are members of the root only; repeated rows are separate turns; an empty table gives no rows
(there is no conversation, so no root). Extra columns are ignored. A conversation is one group when it is rebuilt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import ship, stored
from docfields.llm.manifest import positioned

BLOCK = 1024
BASE_MODULUS = 100
PREFIX_MODULUS = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (turn digests) and lengths (code points of each text) of every rebuilt conversation.

    c takes the first h = crc32(c) % 6 turns of conversation c - c % 100 (all it has, none if absent), then its own
    turns after its first h.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = stored(turns.withColumn("rank", F.row_number().over(order) - 1).drop("turn"), "trie-turns")
    sizes = ranked.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % BASE_MODULUS).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIX_MODULUS).cast("long").alias("h"),
    )
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    convs = stored(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("k")), "trie-convs")
    borrowed = convs.join(ranked.withColumnRenamed("conv_id", "base"), "base").filter(F.col("rank") < F.col("h"))
    own = convs.join(ranked, "conv_id").filter(F.col("rank") >= F.col("h"))
    elements = borrowed.select("conv_id", F.col("rank").alias("at"), "role", "text").unionByName(
        own.select("conv_id", (F.col("k") + F.col("rank") - F.col("h")).alias("at"), "role", "text")
    )
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    sequences = elements.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", digest.alias("key"), F.char_length("text").cast("long").alias("n")))).alias("t")
    )
    return convs.select("conv_id").join(sequences, "conv_id", "left").select(
        "conv_id",
        F.coalesce(F.transform("t", lambda x: x["key"]), F.array().cast("array<binary>")).alias("keys"),
        F.coalesce(F.transform("t", lambda x: x["n"]), F.array().cast("array<long>")).alias("lengths"),
    )


def _lcp(keys: Column, previous: Column) -> Column:
    agree = F.zip_with(keys, previous, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(agree, False)
    return F.when(previous.isNull(), F.lit(-1)).when(first == 0, F.size(keys)).otherwise(first - 1).cast("long")


def _table(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minimum of values[j : j + 2**k]."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        last = levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def first_below(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Per query the first index >= start whose value is below depth; len(values) where there is none."""
    size, cur = len(levels[0]), start.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        ok = cur + step <= size
        probe = np.where(ok, cur, 0)
        skip = ok & (levels[k][probe] >= depth) if size else ok
        cur = np.where(skip, cur + step, cur)
    return cur


def last_below(levels: list[np.ndarray], end: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Per query the last index <= end whose value is below depth; -1 where there is none."""
    cur = end.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        ok = cur - step + 1 >= 0
        probe = np.where(ok, cur - step + 1, 0)
        skip = ok & (levels[k][probe] >= depth) if len(levels[0]) else ok
        cur = np.where(skip, cur - step, cur)
    return cur


def range_min(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, empty: int) -> np.ndarray:
    """Per query the minimum over [left, right]; ``empty`` where the range is empty."""
    width = right - left + 1
    k = np.where(width > 0, np.floor(np.log2(np.maximum(width, 1))).astype(np.int64), 0)
    # Guard against rounding of log2 at powers of two.
    k = np.where((1 << (k + 1)) <= width, k + 1, k)
    k = np.where((1 << k) > np.maximum(width, 1), k - 1, k)
    found = np.full(len(left), empty, np.int64)
    for level in np.unique(k[width > 0]):
        at = (width > 0) & (k == level)
        table = levels[int(level)]
        found[at] = np.minimum(table[left[at]], table[right[at] - (1 << int(level)) + 1])
    return found


NODE_SCHEMA = (
    "start long, depth long, conv_id long, last_len long, r long, r_block long, "
    "parent_start long, p_block long, total long"
)


def _nodes_of_block(blocks: dict, total: int):
    block_lcp, block_conv = _table(blocks["lcp"]), _table(blocks["conv"])
    n_blocks = len(blocks["lcp"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        pos, lcp = frame["pos"].to_numpy(np.int64), frame["lcp"].to_numpy(np.int64)
        conv, size = frame["conv_id"].to_numpy(np.int64), frame["n_turns"].to_numpy(np.int64)
        block, first = int(pos[0]) // BLOCK, int(pos[0])
        local_lcp, local_conv = _table(lcp), _table(conv)
        lows = np.maximum(lcp + 1, 0)
        counts = np.maximum(size - lows + 1, 0)
        at = np.repeat(np.arange(len(pos)), counts)
        depth = lows[at] + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        # Right extent: the first later position of the block whose lcp is below the depth, else in a later block.
        k = first_below(local_lcp, at + 1, depth)
        inside = k < len(pos)
        r = np.where(inside, first + k - 1, -1)
        nxt = first_below(block_lcp, np.full(len(at), block + 1), depth)
        r_block = np.where(inside, -1, np.where(nxt < n_blocks, nxt, -1))
        r = np.where(~inside & (r_block < 0), total - 1, r)
        # The smallest member: within the block up to the end or to r, then whole blocks up to the one asked.
        local_end = np.where(inside, k - 1, len(pos) - 1)
        low = range_min(local_conv, at, local_end, np.iinfo(np.int64).max)
        whole_end = np.where(inside, block, np.where(r_block >= 0, r_block - 1, n_blocks - 1))
        low = np.minimum(low, range_min(block_conv, np.full(len(at), block + 1), whole_end, np.iinfo(np.int64).max))
        # Parent's first member: the last position up to this one whose lcp is below depth - 1.
        parent = depth - 1
        j = last_below(local_lcp, at, parent)
        p_inside = (j >= 0) | (depth == 0)
        prev = last_below(block_lcp, np.full(len(at), block - 1), parent)
        parent_start = np.where(depth == 0, -1, np.where(j >= 0, first + j, -1))
        p_block = np.where(p_inside, -1, prev)
        lengths = frame["lengths"].to_numpy()
        last_len = np.array([int(lengths[i][d - 1]) if d > 0 else 0 for i, d in zip(at, depth)], np.int64)
        return pd.DataFrame({
            "start": pos[at], "depth": depth, "conv_id": low, "last_len": last_len, "r": r, "r_block": r_block,
            "parent_start": parent_start, "p_block": p_block, "total": np.full(len(at), total, np.int64),
        })

    return run


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """For the questions to one block: the first position below a depth (and the least id before it) or the last one."""
    rows = frame[frame["pos"].notna()].sort_values("pos")
    questions = frame[frame["pos"].isna()]
    pos, lcp = rows["pos"].to_numpy(np.int64), rows["lcp"].to_numpy(np.int64)
    conv = rows["conv_id"].to_numpy(np.int64)
    levels, convs = _table(lcp), _table(conv)
    depth, side = questions["q_depth"].to_numpy(np.int64), questions["q_side"].to_numpy()
    right = first_below(levels, np.zeros(len(depth), np.int64), depth)
    left = last_below(levels, np.full(len(depth), len(pos) - 1), depth)
    low = range_min(convs, np.zeros(len(depth), np.int64), right - 1, np.iinfo(np.int64).max)
    place = np.where(side == "R", pos[np.minimum(right, len(pos) - 1)] - 1, pos[np.maximum(left, 0)])
    return pd.DataFrame({"q_block": questions["q_block"].to_numpy(np.int64), "q_depth": depth, "q_side": side,
                         "place": place, "least": np.where(side == "R", low, np.iinfo(np.int64).max)})


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (run_key, conv_id) and gives per run the SHA-256 of its ids, comma-joined."""
    current, digest, first = None, None, True
    out_runs, out_shas = [], []
    for batch in batches:
        runs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for run, conv in zip(runs, ids):
            if run != current:
                if digest is not None:
                    out_runs.append(current)
                    out_shas.append(digest.hexdigest())
                current, digest, first = run, hashlib.sha256(), True
            digest.update((b"" if first else b",") + str(conv).encode())
            first = False
        if len(out_runs) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(out_runs, pa.string()), pa.array(out_shas)], names=["run_key", "ends_sha256"])
            out_runs, out_shas = [], []
    if digest is not None:
        out_runs.append(current)
        out_shas.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(out_runs, pa.string()), pa.array(out_shas)], names=["run_key", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per trie node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and its interval of sorted positions (start, end)."""
    spark = conversations.sparkSession
    ship(spark)
    sequences = rebuilt(conversations).withColumn("_all", F.lit(0))
    placed = positioned(sequences, ["_all"], [F.col("keys"), F.col("conv_id")])
    placed = stored(placed.select("pos", "conv_id", "keys", "lengths", "n"), "trie-placed")
    before = placed.select((F.col("pos") + 1).alias("pos"), F.col("keys").alias("_prev"))
    rows = stored(
        placed.join(before, "pos", "left").select(
            "pos", "conv_id", "lengths", F.size("keys").cast("long").alias("n_turns"), _lcp(F.col("keys"), F.col("_prev")).alias("lcp"),
            (F.col("pos") - F.col("pos") % BLOCK).alias("block_start"), "n", F.sha2(F.concat_ws(",", F.transform("keys", F.hex)), 256).alias("run_key"),
        ),
        "trie-rows",
    )
    summary = rows.groupBy((F.col("pos") / BLOCK).cast("long").alias("block")).agg(
        F.min("lcp").alias("lcp"), F.min("conv_id").alias("conv"), F.max("n").alias("total")
    ).orderBy("block").collect()  # rows / BLOCK rows of three numbers
    if not summary:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string, start long, end long")  # fmt: skip
    blocks = {"lcp": np.array([s.lcp for s in summary], np.int64), "conv": np.array([s.conv for s in summary], np.int64)}
    total = int(summary[0].total)
    candidates = stored(
        rows.select("pos", "conv_id", "lcp", "n_turns", "lengths", "block_start")
        .groupBy("block_start").applyInPandas(_nodes_of_block(blocks, total), NODE_SCHEMA),
        "trie-candidates",
    )
    questions = candidates.filter("r_block >= 0").select(
        F.col("r_block").alias("q_block"), F.col("depth").alias("q_depth"), F.lit("R").alias("q_side")
    ).unionByName(candidates.filter("p_block >= 0").select(
        F.col("p_block").alias("q_block"), (F.col("depth") - 1).alias("q_depth"), F.lit("L").alias("q_side"))
    ).distinct()
    asked = rows.select(
        (F.col("block_start") / BLOCK).cast("long").alias("q_block"), "pos", "lcp", "conv_id",
        F.lit(None).cast("long").alias("q_depth"), F.lit(None).cast("string").alias("q_side"),
    ).join(questions.select("q_block").distinct(), "q_block").unionByName(
        questions.select("q_block", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("lcp"),
                         F.lit(None).cast("long").alias("conv_id"), "q_depth", "q_side")
    )
    answers = stored(
        asked.groupBy("q_block").applyInPandas(_answers, "q_block long, q_depth long, q_side string, place long, least long"),
        "trie-answers",
    )
    right = answers.filter("q_side = 'R'").select(F.col("q_block").alias("r_block"), F.col("q_depth").alias("depth"),
                                                  F.col("place").alias("r_found"), "least")
    left = answers.filter("q_side = 'L'").select(F.col("q_block").alias("p_block"), (F.col("q_depth") + 1).alias("depth"),
                                                 F.col("place").alias("p_found"))
    nodes = (
        candidates.join(right, ["r_block", "depth"], "left").join(left, ["p_block", "depth"], "left")
        .select(
            "start", "depth", "last_len",
            F.when(F.col("r_block") >= 0, F.col("r_found")).otherwise(F.col("r")).alias("end"),
            F.least("conv_id", F.coalesce("least", F.col("conv_id"))).alias("conv_id"),
            F.when(F.col("depth") == 0, F.lit(None)).when(F.col("p_block") >= 0, F.col("p_found"))
            .otherwise(F.col("parent_start")).alias("parent_start"),
        )
    )
    nodes = stored(nodes.withColumn("n_convs", F.col("end") - F.col("start") + 1), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_start").alias("start"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("start").alias("parent_start"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    valued = (
        nodes.join(children, ["start", "depth"], "left").join(parents, ["parent_start", "depth"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("leaf_value", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_value", (F.col("n_convs") - 1) * F.col("last_len"))
    )
    valued = stored(valued, "trie-valued")
    # Sums over positions (l, r] by prefix sums; at l itself only the node and those below it count.
    at_position = valued.groupBy(F.col("start").alias("pos")).agg(F.sum("leaf_value").alias("leaves"), F.sum("saved_value").alias("saved"))
    per_position = rows.select("pos", "block_start").join(at_position, "pos", "left").fillna(0, ["leaves", "saved"])
    in_block = Window.partitionBy("block_start").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = per_position.select("pos", "block_start", F.sum("leaves").over(in_block).alias("l_local"), F.sum("saved").over(in_block).alias("s_local"))
    block_totals = per_position.groupBy("block_start").agg(F.sum("leaves").alias("bl"), F.sum("saved").alias("bs"))
    offsets = block_totals.select(
        "block_start",
        F.coalesce(F.sum("bl").over(Window.orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ol"),
        F.coalesce(F.sum("bs").over(Window.orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("os"),
    )
    prefix = stored(local.join(offsets, "block_start").select("pos", (F.col("l_local") + F.col("ol")).alias("pl"),
                                                              (F.col("s_local") + F.col("os")).alias("ps")), "trie-prefix")
    below = Window.partitionBy("start").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        valued.select("*", F.sum("leaf_value").over(below).alias("l_here"), F.sum("saved_value").over(below).alias("s_here"))
        .join(prefix.select(F.col("pos").alias("end"), F.col("pl").alias("pl_end"), F.col("ps").alias("ps_end")), "end")
        .join(prefix.select(F.col("pos").alias("start"), F.col("pl").alias("pl_start"), F.col("ps").alias("ps_start")), "start")
    )
    # Members whose whole conversation is the node: a run of equal sequences, hashed in id order while streaming.
    runs = rows.groupBy("run_key").agg(F.min("pos").alias("run"), F.min("n_turns").alias("run_depth"))
    # The ids of a run are streamed in order into its digest; only the one row per run meets ``runs`` afterwards.
    digests = rows.select("run_key", "conv_id").repartition("run_key").sortWithinPartitions("run_key", "conv_id").mapInArrow(
        _ends_digest, "run_key string, ends_sha256 string"
    ).join(runs, "run_key")
    result = summed.join(
        digests.select(F.col("run").alias("start"), F.col("run_depth").alias("depth"), "ends_sha256"), ["start", "depth"], "left"
    )
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("pl_end") - F.col("pl_start") + F.col("l_here")).alias("n_leaves"),
        (F.col("ps_end") - F.col("ps_start") + F.col("s_here")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "start", "end",
    )
