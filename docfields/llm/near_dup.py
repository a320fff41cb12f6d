"""Near-duplicates by ProbMinHash.

Shingles are runs of five words, weighted by how often the text has them. Every shingle is a Poisson process with its
weight as the rate; an arrival falls into one of ``REGISTERS`` registers, and a register keeps its earliest arrival.
A shingle stops once its next arrival is later than everything kept (early termination), so a text costs little more
than one arrival per shingle. Two texts agree in a register with the probability of their probability Jaccard
similarity ``J_P = sum_d 1 / sum_e max(a_e / a_d, b_e / b_d)``; for plain sets it is the Jaccard similarity.

1. Texts with the same words are one class; only one representative of each goes on.
2. Bands of registers are buckets. Every bucket has a centre, and each member is compared with it: as many pairs as
   members, whatever the size of the bucket. The centre is the member with the most company over all its buckets;
   a text of which the others are copies keeps the registers that most of them keep.
3. Pairs are verified exactly on the whole texts.
4. Buckets whose members differ from the centre stay open. ``1 - J_P`` is a metric, so only members stay that the triangle
   inequality lets resemble one that no link has joined to the centre's group. Small buckets are compared pair by pair.
   In larger ones the shingles of each member are put in one order, what the centre lacks and the bucket has least often first:
   texts that resemble each other share one of the first few (prefix filter, see ``_split``). Those that share one are the
   next buckets, so copies that changed in different places never meet, and those that changed alike get a centre of their own.
   No link that banding found a bucket for is lost to the groups.
5. Connected components of the links give the class ids (alternating large and small stars).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import map_arrow, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
REGISTERS = BANDS * ROWS
# Buckets of so many members are compared pair by pair; so many times as many in each further round.
FEW = 8
GROWTH = 16
# Shingles that are processed together.
BATCH_SHINGLES = 1_000_000
_EPSILON = 1e-9
# Two texts are alike only if the shares x and y that their common shingles have in them meet 1 / x + 1 / y <= _WIDE.
_WIDE = 1 + 1 / SIMILARITY
# A member is regular if no more than this share of its weight is in shingles that it repeats more often than its centre does.
REGULAR = 0.05

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0x100000001B3)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; ``bytes.split`` knows exactly the ASCII gaps."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def weighted_shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the different shingles in ascending order, and how often each occurs.

    A text of fewer than five words is one shingle; a text without words has none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, SHINGLE)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total = _mixed(total * _SPREAD + hashed[k : n - width + 1 + k])
    return np.unique(total, return_counts=True)


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """The register contents (shingle hashes) of ``owners`` texts; each shingle belongs to the text ``owner``."""
    arrival = np.full(owners * REGISTERS, np.inf)
    content = np.zeros(owners * REGISTERS, dtype=np.uint64)
    time = np.zeros(len(hashes))
    latest = np.full(owners, np.inf)
    salt = np.uint64(0)
    while len(hashes):
        with np.errstate(over="ignore"):
            drawn = _mixed(hashes + salt * _ODD)
            place = _mixed(drawn + _ODD)
        salt += np.uint64(1)
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weights
        going = time < latest[owner]
        hashes, weights, owner, time, place = (x[going] for x in (hashes, weights, owner, time, place))
        slot = owner.astype(np.int64) * REGISTERS + (place % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(arrival, slot, time)
        won = arrival[slot] == time
        content[slot[won]] = hashes[won]
        latest = arrival.reshape(owners, REGISTERS).max(axis=1)
        going = time < latest[owner]
        hashes, weights, owner, time = (x[going] for x in (hashes, weights, owner, time))
    return content.reshape(owners, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One bucket key for every text and band."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64) * _ODD, (len(registers), 1))
    parts = registers.reshape(len(registers), BANDS, ROWS)
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            keys = _mixed(keys * _SPREAD + parts[:, :, row])
    return keys.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (ascending hashes, weights); 0 if either is empty.

    With e sorted by b_e / a_e, the inner maximum is the b-part above the ratio of d and the a-part below it.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    shared, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1][in_a].astype(float), b[1][in_b].astype(float)
    only_x, only_y = float(a[1].sum() - x.sum()), float(b[1].sum() - y.sum())
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    sum_x, sum_y = np.cumsum(x), np.cumsum(y)
    # Elements with a ratio up to that of d count with their x (scaled to d), the others with their y.
    last = np.searchsorted(ratio, ratio, side="right") - 1
    below, above = sum_x[last] + only_x, sum_y[-1] - sum_y[last] + only_y
    return float((1.0 / (below / x + above / y)).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(texts):
            first, digests, sets, size = at, [], [], 0
            while at < len(texts) and size < BATCH_SHINGLES:
                words = split_words(texts[at].as_py())
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                sets.append(weighted_shingles(words))
                size += len(sets[-1][0])
                at += 1
            lengths = [len(s[0]) for s in sets]
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
            hashes = np.concatenate([s[0] for s in sets])
            weights = np.concatenate([s[1] for s in sets]).astype(float)
            keys = band_keys(signatures(hashes, weights, owner, len(sets)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, at - first), pa.array(digests, pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "bands"],
            )


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, digest of the words (null without words) and bucket keys of every row with an id."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    return map_arrow(rows, _sign, f"doc_id {kind}, digest binary, bands array<long>")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """J_P of every pair; rows come sorted by centre, whose shingles are kept from row to row."""
    last: str | None = None
    centre = weighted_shingles([])
    for batch in batches:
        found = []
        for text, centre_text in zip(batch.column(2), batch.column(3), strict=True):
            other = centre_text.as_py()
            if other != last:
                last, centre = other, weighted_shingles(split_words(other))
            found.append(probability_jaccard(weighted_shingles(split_words(text.as_py())), centre))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["member", "centre", "similarity"]
        )


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``differences`` returns; rows come sorted by centre, both texts last."""
    last: str | None = None
    centre = weighted_shingles([])
    for batch in batches:
        numbers, new, weights, old, before = [], [], [], [], []
        known = batch.num_columns - 2
        for text, centre_text in zip(batch.column(known), batch.column(known + 1), strict=True):
            other = centre_text.as_py()
            if other != last:
                last, centre = other, weighted_shingles(split_words(other))
            shingles, counts = weighted_shingles(split_words(text.as_py()))
            held = np.isin(shingles, centre[0], assume_unique=True)
            more = counts[held] - centre[1][np.searchsorted(centre[0], shingles[held])]
            total, off = int(counts.sum()), int(counts[~held].sum())
            numbers.append((total, off, int(np.maximum(more, 0).sum()) + off - int((~held).sum()), int(np.maximum(-more, 0).sum())))
            so_far = off + np.cumsum(counts[held]) - counts[held]
            early = so_far <= (1 - SIMILARITY) * total + 1e-6
            new.append(shingles[~held].view(np.int64))
            weights.append(counts[~held])
            old.append(shingles[held][early].view(np.int64))
            before.append(so_far[early])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (new, weights, old, before)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:known], *[pa.array([n[k] for n in numbers], pa.int64()) for k in range(4)], *lists],
            names=[*batch.schema.names[:known], "total", "new_total", "up", "down", "new", "new_weights", "old", "old_before"],
        )


def _with_texts(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of ``pairs`` and both texts."""
    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    members = pairs.join(texts, pairs["member"] == texts["doc_id"]).select(*pairs.columns, F.col("text").alias("member_text"))
    return members.join(texts, members["centre"] == texts["doc_id"]).select(*pairs.columns, "member_text", "text")


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """member, centre and their exact similarity."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(_with_texts(pairs, documents), _verify, f"member {kind}, centre {kind}, similarity double")


def differences(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of ``pairs``, the member's weight, what of it is in shingles that the centre lacks, by how much the weights of its shingles are
    higher (``up``) and lower (``down``) than the centre's or, where that has none, than one, the shingles that the centre lacks
    (``new``) with their weights, and of the others those that have up to 1 - SIMILARITY of the member's weight before them
    (``old``), if ``new`` comes first and the others follow by their hashes."""
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in pairs.schema) + (
        ", total long, new_total long, up long, down long, "
        "new array<long>, new_weights array<long>, old array<long>, old_before array<long>"
    )
    return map_arrow(_with_texts(pairs, documents), _differ, schema)


def _crowded(signed_representatives: DataFrame) -> DataFrame:
    """bucket, member and degree of all members of buckets with several: the members of all buckets of a member."""
    exploded = signed_representatives.select(F.col("doc_id").alias("member"), F.explode("bands").alias("bucket"))
    crowds = stored(exploded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "crowds")
    # A member has a bucket for each band at most.
    members = exploded.join(crowds, "bucket").groupBy("member").agg(F.sum("size").alias("degree"), F.collect_list("bucket").alias("buckets"))
    return stored(members.select(F.explode("buckets").alias("bucket"), "member", "degree"), "members")


def _most_connected() -> Column:
    """Of the members of a group, the one with the highest degree (of equals, the largest id)."""
    return F.max(F.struct("degree", "member"))["member"].alias("centre")


def _pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    return members.join(centres, "bucket").filter(F.col("member") != F.col("centre")).select("member", "centre").distinct()


def _within(distance: Column) -> Column:
    return distance <= 1 - SIMILARITY + _EPSILON


def _open(state: DataFrame) -> DataFrame:
    """The members of each bucket that may have a link to find: unplaced ones, and placed ones that may resemble one of them.

    ``state`` has bucket, centre, member, degree, the distance to the centre, placed (in the centre's group), the group,
    and ``short``: one of each two that are to be compared has it. The distances of two members that resemble each other
    differ by no more than two alike texts may differ. The other columns come from ``_split``; in a ``mixed`` bucket only pairs
    of which not both are ``regular`` are to be compared.
    """
    reach = 1 - SIMILARITY + _EPSILON
    free = F.when(~F.col("placed"), F.col("distance"))
    fixed = F.when(F.col("placed"), F.col("distance"))
    needs = (
        state.groupBy("bucket").agg(
            F.count(free).alias("unplaced"), F.min(free).alias("nearest"), F.max(free).alias("farthest"),
            F.min(fixed).alias("placed_nearest"), F.max(fixed).alias("placed_farthest"),
            F.min("group").alias("lowest"), F.max("group").alias("highest"), F.count_if("short").alias("shorts"),
            F.bool_and(F.col("mixed") & F.col("regular")).alias("elsewhere"),
        )
        .filter((F.col("shorts") > 0) & (F.col("lowest") != F.col("highest")) & ~F.col("elsewhere"))
        .filter((F.col("unplaced") > 1) | (
            (F.col("unplaced") == 1) & (F.col("placed_farthest") >= F.col("nearest") - reach)
            & (F.col("placed_nearest") <= F.col("farthest") + reach)))
        .select("bucket", "nearest", "farthest")
    )
    within = F.col("distance").between(F.col("nearest") - reach, F.col("farthest") + reach)
    return stored(
        state.join(needs, "bucket").filter(~F.col("placed") | within).drop("nearest", "farthest"),
        "open-members",
    )


def _parted(state: DataFrame, few: int, unplaced: int = 0) -> tuple[DataFrame, DataFrame]:
    """The members of buckets with no more than ``few`` short ones or ``unplaced`` unplaced ones, and those of larger buckets."""
    sizes = state.groupBy("bucket").agg(
        (F.when((F.count_if("short") <= few) | (F.count_if(~F.col("placed")) <= unplaced), "small").otherwise("large")).alias("part"))
    sized = state.join(sizes, "bucket")
    return sized.filter(F.col("part") == "small").drop("part"), sized.filter(F.col("part") == "large").drop("part")


def _may_be_alike() -> Column:
    """Whether two members can be alike that have no common shingle before the one of their bucket (see ``_split``)."""
    a_left, b_left = (F.col(f"{side}_total") - F.col(f"{side}_before") for side in ("a", "b"))
    a_shared = F.least(a_left, b_left + F.col("a_up") + F.col("b_down"))
    b_shared = F.least(b_left, a_left + F.col("b_up") + F.col("a_down"))
    alike = F.col("a_total") / a_shared + F.col("b_total") / b_shared <= _WIDE + 1e-6
    return alike & ~(F.col("a_mixed") & F.col("a_regular") & F.col("b_regular"))


# What else a member has in its bucket.
_PLACE = ("short", "total", "before", "up", "down", "regular", "mixed")


def _all_pairs(state: DataFrame) -> DataFrame:
    """member and centre of all pairs of a bucket that are to be compared and that no link has joined yet."""
    columns = ("bucket", "member", "distance", "placed", "group", *_PLACE)
    one, other = (state.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in columns[1:]]) for side in ("a", "b"))
    wanted = (
        F.col("b_short") & (F.col("a_group") != F.col("b_group")) & ~(F.col("a_placed") & F.col("b_placed"))
        & (~F.col("a_short") | (F.col("a_member") < F.col("b_member"))) & _within(F.abs(F.col("a_distance") - F.col("b_distance")))
        & _may_be_alike()
    )
    pair = F.least("a_member", "b_member").alias("member"), F.greatest("a_member", "b_member").alias("centre")
    return one.join(other.filter("b_short"), one["bucket"] == other["bucket"]).filter(wanted).select(*pair)


def _split(state: DataFrame, documents: DataFrame) -> DataFrame:
    """The members of large buckets in smaller ones: those that share one of the first shingles of each.

    ``J_P`` is at most xy / (x + y - xy), if the shared shingles are the shares x and y of the weights of two texts. In one order of all
    shingles, nothing shared comes before the first shared one; with the shares u and v before it, alike texts meet
    1 / (1 - u) + 1 / (1 - v) <= _WIDE. So one of them has no more than 1 - 2 / _WIDE of its weight before it (``short``), and
    the other no more than 1 - SIMILARITY. What is shared weighs about the same in both, too: in one no more than in the other
    and ``up`` of the one and ``down`` of the other (nothing, if no shingle is repeated). With the least weight and the highest
    ``up`` of the others this limits what a member has before it. So that a few odd members do not lift the limit for all, it is
    taken over ``regular`` members, and pairs with others meet in ``mixed`` buckets.

    The order: shingles that the centre lacks, by how often the members have them, then its own. Members whose changes
    nobody shares thus have no bucket, as far as they are unlike the centre. Placed members are compared with unplaced
    ones only; of the centre's shingles these have ``most`` at most, which is the share ``best`` of a text at most.
    """
    kept = "degree", "distance", "placed", "group"
    known = stored(differences(state.select("centre", "member", *kept).distinct(), documents), "differences")
    known = known.withColumn("regular", F.col("up") <= REGULAR * F.col("total"))
    regular, unplaced = F.col("regular"), ~F.col("placed")
    size, held = F.col("total"), F.col("total") - F.col("new_total")
    crowds = known.groupBy("centre").agg(
        F.bool_and(regular).alias("all_regular"), F.min(F.when(regular, size)).alias("lightest"), F.max(F.when(regular, F.col("up"))).alias("highest"),
        F.max(F.when(regular & unplaced, held + F.col("down"))).alias("most"), F.max(F.when(regular & unplaced, held / size)).alias("best"),
    )
    limited = known.join(crowds, "centre")
    columns = "centre", "member", *kept, "total", "up", "down", "regular", *crowds.columns[1:]
    changes = stored(
        known.select("centre", "member", F.explode(F.arrays_zip("new", "new_weights")).alias("entry"))
        .select("centre", "member", F.col("entry.new").alias("shingle"), F.col("entry.new_weights").alias("weight")),
        "changes",
    )
    shared = stored(changes.groupBy("centre", "shingle").agg(F.count("*").alias("often")).filter("often > 1"), "shared-shingles")
    # Shingles of one member only come first in the order, and no other member has them.
    text = Window.partitionBy("centre", "member", "total", "new_total", "up", "down")
    earlier = text.orderBy("often", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    new = (
        changes.join(shared, ["centre", "shingle"]).join(limited.select(*columns, "new_total"), ["centre", "member"])
        .withColumn("before", F.col("new_total") - F.sum("weight").over(text) + F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .select(*columns, "shingle", "before", F.lit(True).alias("meets"))
    )

    def meets(before: Column) -> Column:
        """Whether a placed member can be alike to an unplaced one that shares none but the centre's shingles with it."""
        both = F.least(size - before, F.col("most") + F.col("up"))
        return unplaced | (size / both + 1 / F.col("best") <= _WIDE + 1e-6)

    within = F.filter(F.arrays_zip("old", "old_before"), lambda entry: ~F.col("all_regular") | meets(entry["old_before"]))
    old = (
        limited.select(*columns, F.explode(within).alias("entry"))
        .select(*columns, F.col("entry.old").alias("shingle"), F.col("entry.old_before").alias("before"))
        .withColumn("meets", meets(F.col("before")))
    )
    left = size - F.col("before")
    reaches = size / left + F.greatest(F.lit(1.0), F.col("lightest") / (left + F.col("highest") + F.col("down"))) <= _WIDE + 1e-6
    kinds = F.array_compact(F.array(
        F.when(regular & F.col("meets") & reaches, F.lit(False)),
        F.when(~F.col("all_regular") & (F.col("before") <= size * (1 - SIMILARITY) + 1e-6), F.lit(True)),
    ))
    return (
        new.union(old).withColumn("mixed", F.explode(kinds))
        .withColumn("short", F.col("before") <= size * (1 - 2 / _WIDE) + 1e-6)
        .select(F.xxhash64("centre", "shingle", "mixed").alias("bucket"), "centre", "member", *kept, *_PLACE)
    )


def _new_centres(state: DataFrame) -> DataFrame:
    """One of the short members of each bucket: an unplaced one, if there is any, with the most company."""
    best = F.max(F.struct(~F.col("placed"), "degree", "member", "group"))
    chosen = state.filter("short").groupBy("bucket").agg(best.alias("best"))
    return chosen.select("bucket", F.col("best.member").alias("new"), F.col("best.group").alias("new_group"))


def _around(state: DataFrame, centres: DataFrame, results: DataFrame) -> DataFrame:
    """The state once all members of each bucket have been compared with its new centre, which has no further link to find."""
    measured = results.select("member", F.col("centre").alias("new"), "similarity")
    found = state.join(centres, "bucket").filter(F.col("member") != F.col("new")).join(measured, ["member", "new"])
    distance = 1 - F.col("similarity")
    return found.select(
        "bucket", F.col("new").alias("centre"), "member", "degree", distance.alias("distance"),
        (_within(distance) | (F.col("group") == F.col("new_group"))).alias("placed"), "group", *_PLACE,
    )


def groups_of(signed_representatives: DataFrame, documents: DataFrame) -> DataFrame:
    """node and component of every text that is linked to a different one (ids of representatives)."""
    def near(results: DataFrame) -> DataFrame:
        return results.filter(F.col("similarity") >= SIMILARITY - _EPSILON).select("member", "centre")

    members = _crowded(signed_representatives)
    centres = stored(members.groupBy("bucket").agg(_most_connected()), "centres")
    results = stored(verified(_pairs(members, centres), documents), "verified")
    # One round joins most; what it has not joined yet is compared more often, and joined at last.
    linked = _stars(near(results), rounds=1)
    nodes = linked.select(F.col("a").alias("node"), "b").union(linked.select(F.col("b").alias("node"), "b"))
    labels = stored(nodes.groupBy("node").agg(F.min("b").alias("label")), "labels")
    groups = stored(labels.join(labels.toDF("of", "component"), F.col("label") == F.col("of")).select("node", "component"), "groups")
    group_of_centre = groups.select(F.col("node").alias("centre"), F.col("component").alias("centre_group"))
    group_of_member = groups.select(F.col("node").alias("member"), F.col("component").alias("member_group"))
    distance = 1 - F.col("similarity")
    # What links elsewhere have joined to the centre's group has nothing more to find out about it.
    group = F.coalesce("member_group", "member")
    state = _open(stored(
        members.join(centres, "bucket").join(results, ["member", "centre"])
        .join(group_of_member, "member", "left").join(group_of_centre, "centre", "left")
        .select("bucket", "centre", "member", "degree", distance.alias("distance"),
                (_within(distance) | (group == F.coalesce("centre_group", "centre"))).alias("placed"),
                group.alias("group"), F.lit(True).alias("short"), F.lit(1).cast("long").alias("total"),
                *[F.lit(0).cast("long").alias(name) for name in ("before", "up", "down")],
                F.lit(False).alias("regular"), F.lit(False).alias("mixed")),
        "after",
    ))
    found: list[DataFrame] = []
    few = FEW
    # The texts of all that may still be compared: few, if there are few large groups.
    wanted = state.select(F.col("member").alias("open_id")).union(state.select("centre"))
    documents = stored(
        documents.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("open_id"), "left_semi"), "open-texts")
    while not state.isEmpty():
        small, large = _parted(state, few)
        pairs = _all_pairs(small)
        crowd = centres = None
        if not large.isEmpty():
            small, crowd = _parted(_open(stored(_split(large, documents), "split")), few, FEW)
            centres = _new_centres(crowd)
            around = crowd.join(centres, "bucket").filter(F.col("member") != F.col("new"))
            pairs = pairs.union(_all_pairs(small)).union(around.select("member", F.col("new").alias("centre")))
        results = stored(verified(pairs.distinct(), documents), "verified")
        found.append(near(results))
        if crowd is None or crowd.isEmpty():
            break
        state = _open(stored(_around(crowd, centres, results), "after"))
        few *= GROWTH
    edges = linked.toDF("member", "centre")
    for more in found:
        edges = edges.union(more)
    return components(edges)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars: every node but the smallest of its part, and that smallest one."""
    for batch in batches:
        least: dict = {}
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ends = []
            for node in (a, b):
                while (lower := least.setdefault(node, node)) != node:
                    least[node] = least[lower]
                    node = lower
                ends.append(node)
            least[max(ends)] = min(ends)
        # Nodes link smaller ones only, so these have found their least one before.
        for node in sorted(least):
            least[node] = least[least[node]]
        stars = [(node, lowest) for node, lowest in least.items() if node != lowest]
        kinds = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array([star[k] for star in stars], kinds) for k in (0, 1)], names=["a", "b"])


def _stars(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the same nodes as the edges (member, centre).

    Alternating large and small stars: each node links its larger neighbours, then itself and its smaller ones, to the least
    node around it, until every edge ends at a component's least node, or for so many rounds. Before each of them the edges
    that are read together are joined to stars, which shortens long paths. Each step is one stored table.
    """
    kind = edges.schema["member"].dataType.simpleString()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("lowest")).select("a", F.least("a", "lowest").alias("lowest")), "least")
        moved = F.when(F.col("b") > F.col("a") if large else F.col("b") <= F.col("a"), F.struct(F.col("b").alias("a"), F.col("lowest").alias("b")))
        kept = F.when(F.col("b") == F.col("lowest"), F.struct("a", F.col("lowest").alias("b")))
        linked = both.join(least, "a").select(F.explode(F.array_compact(F.array(moved, kept))).alias("edge"))
        return linked.select("edge.a", "edge.b").filter("a != b")

    def joined(pairs: DataFrame) -> DataFrame:
        return map_arrow(pairs, _joined, f"a {kind}, b {kind}")

    def unfinished(pairs: DataFrame) -> bool:
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("ends"), (F.col("a") <= F.col("b")).alias("upward")).union(
            pairs.select(F.col("b").alias("node"), F.lit(0), F.lit(False)))
        counted = ends.groupBy("node").agg(F.sum("ends").alias("starts"), F.min("ends").alias("least"), F.max("upward").alias("upward"))
        return not counted.filter("starts > 1 or (starts = 1 and least = 0) or upward").isEmpty()

    pairs = stored(joined(edges.select(F.col("member").alias("a"), F.col("centre").alias("b"))), "edges")
    done = 0
    while done < rounds if rounds is not None else unfinished(pairs):
        done += 1
        # A star has a row for each edge and each node at most, so copies of an edge may wait until the second one.
        pairs = stored(star(stored(star(pairs, large=True), "stars"), large=False).distinct(), "stars")
        pairs = stored(joined(pairs), "edges")
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node on an edge (member, centre)."""
    pairs = _stars(edges)
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) for every row of ``documents``.

    Null, empty and blank texts resemble nothing and are classes of their own; rows without an id have a null class.
    Texts with the same words are one class, whatever stands between the words. A text of fewer than five words is one
    shingle. Rows that share an id count as one document. Other columns are not read. No rows give no rows.
    """
    rows = stored(signed(documents), "signed")
    with_words = rows.filter(F.col("digest").isNotNull())
    # Equal words have equal buckets.
    classes = stored(with_words.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "copies")
    groups = groups_of(classes.select(F.col("first_id").alias("doc_id"), "bands"), documents)
    named = stored(
        classes.drop("bands").join(groups, F.col("first_id") == F.col("node"), "left")
        .select(F.col("digest").alias("class_digest"), F.coalesce("component", "first_id").alias("class_id")),
        "classes",
    )
    placed = with_words.join(named, F.col("digest") == F.col("class_digest")).select("doc_id", "class_id")
    wordless = rows.filter(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    without_id = documents.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    return placed.union(wordless).union(without_id)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with the smallest id of their class, all columns as they are; rows without an id stay."""
    surplus = near_duplicates(documents).filter(F.col("doc_id") != F.col("class_id")).select(
        F.col("doc_id").alias("surplus_id")).distinct()
    surplus = stored(surplus, "surplus")
    return documents.join(surplus, documents["doc_id"] == surplus["surplus_id"], "left_anti")
