"""Merkle dataset manifest: a persistent tree over all rows, where each tampered leaf makes a version by path copying.

Every row is a leaf, H of its fields; leaves of a language ascend by ``doc_id`` (then by leaf, so equal ids have a
defined order), and every two consecutive nodes of a level become their H until one node is left, a lone last node
being hashed alone. The languages' subroots, ordered by language (null first, bytewise), give the root in the same way.
H is the lowercase hex SHA-256 of its inputs concatenated, digests taken as their hex text.

How it is laid out: a level is cut into aligned blocks of ``BLOCK = 2**LEVELS_PER_BLOCK`` nodes. Blocks never
straddle a pair, so the lower ``LEVELS_PER_BLOCK`` levels of a block are those of the whole tree, and a block is one
small group (at most 1,024 hashes) whatever the size of its language. The block roots form the next, 1,024 times
smaller level, which is folded the same way, until one node per language is left; four such rounds cover 10**12
rows. Positions come from one range shuffle (a hot language is split like any other range) and a table of counts
per partition. Each node keeps its path: the sibling at every level (null where a lone node is hashed alone) and
its side, the block's path being shared by its 1,024 nodes through a join, never copied into a group.

A tampered leaf makes its own version: its ancestors are recomputed from the new leaf and the original siblings
(``fold``), and every other node is shared. ``folded_root`` is that version's root; it equals the original root
exactly where the tampered leaf equals the original.

Odd input: a null field is written ``-``; null ids come first; repeated rows are separate, equal leaves next to each
other; ids may be of any orderable type (integers are written in decimal, others as their text). Empty and very
long texts are hashed whole. An empty table gives no rows. Extra input columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import stored

LEVELS_PER_BLOCK = 10
# Copies of each language's row in the last join, so that one language's leaves spread over so many tasks.
SALTS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The rows whose unsigned crc32 of the decimal id this divides are tampered with by ``tamper``.
TAMPER_MODULUS = 7
_MASK33 = (1 << 33) - 1


def encoded(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, ``:`` and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def tampered(doc_id: Column, n_chars: Column) -> Column:
    """The changed ``n_chars`` of a tampered row: one more; nulls stay; other rows keep theirs."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_MODULUS == 0, F.lit(False))
    return F.when(hit, n_chars + 1).otherwise(n_chars)


def positioned(frame: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``frame`` with ``pos`` (from 0 within its group, in ``order``) and ``n`` (rows of the group).

    One range shuffle sorts all rows; a row's place in its partition comes from the id that Spark numbers
    rows of a partition with, and the counts per (partition, group), a table of at most partitions + groups rows,
    give the offsets. The result is stored, so a lost executor recomputes nothing of the numbering.
    """
    keys = [F.col(g) for g in group] + order
    tagged = (
        frame.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .select("*", F.shiftright("_mid", 33).alias("_part"), F.col("_mid").bitwiseAND(F.lit(_MASK33)).alias("_local"))
        .drop("_mid")
    )
    tagged = stored(tagged, "manifest-tagged")
    counts = tagged.groupBy("_part", *group).agg(F.min("_local").alias("_first"), F.count("*").alias("_count"))
    by_group = Window.partitionBy(*group)
    counts = counts.select(
        "_part", *group, "_first",
        F.coalesce(F.sum("_count").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_count").over(by_group).alias("n"),
    )
    counts = counts.select([F.col(c).alias(f"_c{c}") for c in counts.columns])
    joined = tagged.join(
        counts,
        reduce(lambda a, b: a & b, [tagged["_part"] == counts["_c_part"]] + [tagged[g].eqNullSafe(counts[f"_c{g}"]) for g in group]),
    )
    return joined.select(
        *[c for c in tagged.columns if c not in ("_part", "_local")],
        (F.col("_c_before") + F.col("_local") - F.col("_c_first")).alias("pos"),
        F.col("_cn").alias("n"),
    )


_FOLD = "transform(sequence(0, (size({a}) - 1) div 2), j -> sha2(concat(get({a}, 2 * j), coalesce(get({a}, 2 * j + 1), '')), 256))"


def _block_paths(nodes: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per node its path inside its block; per block its root, the next level's node."""
    width = 1 << LEVELS_PER_BLOCK
    blocks = nodes.groupBy(*group, F.shiftright("pos", LEVELS_PER_BLOCK).alias("_blk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("_hashes"),
        F.max("n").alias("_n"),
    )
    # A group of at most one block folds until one node is left; larger ones fold all levels of every block.
    last = "get(acc, size(acc) - 1)"
    levels = F.expr(
        f"""
        aggregate(sequence(1, {LEVELS_PER_BLOCK}), array(_hashes),
          (acc, l) -> IF(_n > {width} OR size({last}) > 1, concat(acc, array({_FOLD.format(a=last)})), acc))
        """
    )
    blocks = stored(blocks.select(*group, "_blk", "_n", levels.alias("_levels")), "manifest-blocks")
    paths = blocks.select(
        *group, "_blk",
        F.posexplode(F.get(F.col("_levels"), 0)).alias("_i", "_leaf"),
        F.expr("size(_levels) - 1").alias("_nlev"), "_levels",
    ).select(
        *group, "_blk", "_leaf",
        (F.col("_blk") * width + F.col("_i")).alias("pos"),
        F.expr(
            "transform(IF(_nlev > 0, sequence(0, _nlev - 1), array()), l -> named_struct("
            "'sib', get(get(_levels, l), shiftright(_i, l) ^ 1), 'right', (shiftright(_i, l) & 1) = 1))"
        ).alias("path"),
    )
    roots = blocks.select(
        *group, F.col("_blk").alias("pos"),
        F.expr("get(get(_levels, size(_levels) - 1), 0)").alias("hash"),
        F.expr(f"CAST((_n + {width - 1}) DIV {width} AS BIGINT)").alias("n"),
        (F.col("_n") <= width).alias("_last"),
    )
    return paths, roots


def tree(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Per node of ``nodes`` (``group``, ``pos``, ``n``, ``hash``): ``path`` up to its group's root, and ``root``.

    ``path`` lists from the bottom one struct per level: ``sib`` the sibling's hash (null where the node is
    hashed alone) and ``right`` whether the node is the right one of its pair.
    """
    paths, roots = _block_paths(nodes, group)
    roots = stored(roots, "manifest-roots")
    if roots.filter(~F.col("_last")).isEmpty():
        upper = roots.select(*group, F.col("pos").alias("_blk"), F.array().cast(paths.schema["path"].dataType).alias("_up"),
                             F.col("hash").alias("root"))
    else:
        upper = tree(roots.drop("_last"), group).select(*group, F.col("pos").alias("_blk"), F.col("path").alias("_up"), "root")
    upper = upper.select([F.col(c).alias(f"_u{c}") for c in upper.columns])
    joined = paths.join(
        upper,
        reduce(lambda a, b: a & b, [paths["_blk"] == upper["_u_blk"]] + [paths[g].eqNullSafe(upper[f"_u{g}"]) for g in group]),
    )
    return joined.select(*group, "pos", F.col("_leaf").alias("hash"), F.concat("path", "_u_up").alias("path"),
                         F.col("_uroot").alias("root"))


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` reaches along ``path``: the root of the version where only this node changed."""
    return F.aggregate(
        path,
        start,
        lambda acc, s: F.when(s["sib"].isNull(), F.sha2(acc, 256))
        .when(s["right"], F.sha2(F.concat(s["sib"], acc), 256))
        .otherwise(F.sha2(F.concat(acc, s["sib"]), 256)),
    )


def proof_digest(path: Column) -> Column:
    """H of the siblings along ``path``, bottom up (left to right inside a level)."""
    return F.sha2(F.array_join(F.transform(F.filter(path, lambda s: s["sib"].isNotNull()), lambda s: s["sib"]), ""), 256)


def manifest(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, leaf, subroot, root, path (siblings to the root), proof_sha256, tampered_leaf,
    folded_root (the root of the version where only this row was tampered with) and verified (it equals root)."""
    rows = documents.select(
        *[F.col(c).alias(f"_{c}") for c in FIELDS],
    ).select(
        F.col("_doc_id").alias("doc_id"), F.col("_lang").alias("lang"),
        leaf(*(F.col(f"_{c}") for c in FIELDS)).alias("hash"),
        leaf(F.col("_doc_id"), F.col("_source"), F.col("_lang"), tampered(F.col("_doc_id"), F.col("_n_chars")),
             F.col("_text")).alias("tampered_leaf"),
    )
    leaves = positioned(rows, ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("hash")])
    below = stored(tree(leaves.select("lang", "pos", "n", "hash"), ["lang"]), "manifest-below")
    subroots = positioned(
        below.select("lang", F.col("root").alias("hash")).dropDuplicates(["lang"]).withColumn("_all", F.lit(0)),
        ["_all"], [F.col("lang").asc_nulls_first()],
    )
    above = tree(subroots.select("_all", "pos", "n", "hash"), ["_all"]).join(subroots.select("_all", "pos", "lang"), ["_all", "pos"])
    # One row per language meets all leaves of that language: salted, so a language with a third of all rows is spread
    # over SALTS tasks (its row is copied to each), whatever the number of languages.
    above = above.select(
        F.col("lang").alias("_lang"), F.col("hash").alias("subroot"), F.col("path").alias("_above"), "root",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    full = (
        below.drop("root").join(leaves.select(F.col("lang").alias("_l"), F.col("pos").alias("_p"), "doc_id", "tampered_leaf"),
                   F.col("lang").eqNullSafe(F.col("_l")) & (F.col("pos") == F.col("_p")))
        .join(above, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("pos") % SALTS == F.col("_salt")))
    )
    path = F.concat("path", "_above")
    return full.select(
        "doc_id", "lang", F.col("hash").alias("leaf"), "subroot", "root", path.alias("path"),
        proof_digest(path).alias("proof_sha256"), "tampered_leaf",
        fold(F.col("tampered_leaf"), path).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
