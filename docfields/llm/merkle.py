"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Leaves are pieces of at most eight words of a paragraph (a line), so that an edit inside a long paragraph touches
only the pieces after it. Paragraphs are hashes over their pieces, sections (paragraphs between blank lines)
hashes over their paragraphs, and the root is a SHA-256 digest over the sections. Equal roots mean equal texts;
below different roots, only branches with different hashes need a look to locate an edit.

The fingerprint is one string that holds the tree: ``root/section/section...``, where a section is
``hash:paragraph;paragraph...`` and a paragraph ``piece,piece...``; the hash of a paragraph follows from its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import let

PIECE = r"[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,8}|[\x20\x09\x0B-\x0D]+"
BLANK_LINES = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
HASH_DIGITS = 12
# Documents of a block of neighbours, and the most blocks.
BLOCK_DOCUMENTS = 1024
MOST_BLOCKS = 1 << 16


def _short(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS)


def _pieces(paragraph: Column) -> Column:
    found = F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0))
    return F.array_join(F.transform(found, _short), ",")


def _section(section: Column) -> Column:
    paragraphs = F.transform(F.split(section, "\n"), _pieces)
    return let(
        paragraphs,
        lambda ps: F.concat(_short(F.array_join(F.transform(ps, _short), "")), F.lit(":"), F.array_join(ps, ";")),
    )


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string. A null text has the fingerprint of the empty text.

    The root also covers the text itself, so blank lines and other spacing between equal pieces count.
    """
    full = F.coalesce(text, F.lit(""))
    sections = F.transform(F.split(full, BLANK_LINES), _section)
    return let(
        sections,
        lambda found: F.concat(
            F.sha2(
                F.concat(F.array_join(F.transform(found, lambda s: F.substring_index(s, ":", 1)), ""), F.sha2(full, 256)), 256
            ),
            F.lit("/"),
            F.array_join(found, "/"),
        ),
    )


def root(tree: Column) -> Column:
    return F.substring_index(tree, "/", 1)


def _sections(tree: Column) -> Column:
    return F.slice(F.split(tree, "/"), F.lit(2), F.size(F.split(tree, "/")))


def _leaves(sections: Column) -> Column:
    """The pieces below the given sections; empty paragraphs have none."""
    below = F.array_join(F.transform(sections, lambda s: F.substring_index(s, ":", -1)), ",")
    return F.array_distinct(F.filter(F.split(below, "[,;]"), lambda piece: piece != ""))


def likeness(left: Column, right: Column) -> Column:
    """The share of different pieces that two trees have in common, from 0 to 1 (1 if neither has any piece)."""
    def ratio(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(1.0))

    nested = let(_leaves(_sections(left)), lambda a: let(_leaves(_sections(right)), lambda b: ratio(a, b)))
    return F.when(root(left) == root(right), F.lit(1.0)).otherwise(nested)


def differing_sections(left: Column, right: Column) -> Column:
    """Places (from 0) of the sections whose branches differ; sections that only one tree has count as different."""
    def places(a: Column, b: Column) -> Column:
        marks = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
        return F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())

    found = let(_sections(left), lambda a: let(_sections(right), lambda b: places(a, b)))
    return F.when(root(left) == root(right), F.array().cast("array<int>")).otherwise(found)


def with_next(documents: DataFrame) -> DataFrame:
    """Every document with the next one by descending doc_id (after the last, the first): doc_id, text, tree, next_text, next_tree.

    Documents are dealt into blocks of neighbours between doc_ids that are quantiles of all, and ordered within
    their block only. The first document of a block also goes to the end of the block before it (of the first
    block, to the last), so every document meets its neighbour in one exchange of the texts. Null ids come last;
    rows with equal ids are ordered by text; a single document is its own neighbour; texts that are null count as empty.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("order_key"))
    keys = documents.select(key.alias("order_key"))
    count = documents.count()
    blocks = min(MOST_BLOCKS, max(1, -(-count // BLOCK_DOCUMENTS)))
    percentages = F.array(*[F.lit(i / blocks) for i in range(blocks)])
    found = keys.agg(F.max("order_key"), F.percentile_approx("order_key", percentages, F.lit(max(10000, 10 * blocks)))).first()
    # Descending first ids of the blocks; each is the id of a document.
    heads = sorted({found[0], *(found[1] or [])} - {None}, reverse=True)[: max(1, blocks)] or [0]
    ascending = F.lit(sorted(heads))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(heads).bit_length()))])
    # Binary search: how many heads are smaller than the key.
    smaller = F.aggregate(
        steps, F.lit(0), lambda n, step: F.when(F.get(ascending, n + step - 1) < F.col("order_key"), n + step).otherwise(n)
    )
    placed = keyed.withColumn("block", F.least(F.lit(len(heads) - 1), F.lit(len(heads) - 1) - smaller))
    is_head = F.get(ascending, F.lit(len(heads) - 1) - F.col("block")) == F.col("order_key")
    own = F.struct(F.col("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("block") - 1, F.lit(len(heads))).alias("block"), F.lit(True).alias("guest"))
    rows = (
        placed.select("doc_id", "text", "order_key", fingerprint(F.col("text")).alias("tree"),
                      F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
        .select("doc_id", "text", "order_key", "tree", "at.block", "at.guest")
    )
    order = Window.partitionBy("block").orderBy("guest", F.col("order_key").desc(), "text")
    return (
        rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_tree", F.lead("tree").over(order))
        .filter(~F.col("guest")).select("doc_id", "text", "tree", "next_text", "next_tree")
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def neighbours(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row of
    ``documents`` (columns doc_id and text are read, others ignored), none for an empty table.
    """
    rows = with_next(documents).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_tree", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree").alias("fingerprint"), F.col("edited_tree").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )
