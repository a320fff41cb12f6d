"""Words to pages to documents.

A word table has one row per recognised word (``schemas.WORDS``). Pages without any word still exist: either
their blank words are in the table, or a page list is passed along.

Texts are assembled in two steps. Words are first joined in *parts* of at most ``PART_WORDS`` positions, so
the group that is sorted in memory stays small however many words a document or page holds, and the words of
a huge document are spread over many tasks. Only the finished part texts meet in the row of their document.
A part holds the words of up to ``PAGE_GROUP`` neighbouring pages, which move as one row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from docfields.functions.text import strip

PART_WORDS = 4096
PAGE_GROUP = 32
PAGE_BLOCK = 1024

# Exact, so that the sum does not depend on the order in which partial sums arrive.
# A confidence is at most three digits before the point; sixteen behind it keep every digit of a double.
_CONFIDENCE_SUM_TYPE = "decimal(20,16)"


def clean_words(words: DataFrame) -> DataFrame:
    """Trim words, drop blank ones, scale the confidence to 0..1 and turn sizes into a corner box."""
    return (
        words.withColumn("text", strip(F.col("text")))
        .filter(F.col("text") != "")
        .withColumn("confidence", F.col("conf") / 100)
        .withColumn(
            "bbox",
            F.array(
                F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height")
            ),
        )
        .drop("conf", "left", "top", "width", "height")
    )


def cap_pages(words: DataFrame, max_pages: int | None) -> DataFrame:
    """Keep the first ``max_pages`` pages of every document (all for None)."""
    return words if max_pages is None else words.filter(F.col("page_index") < max_pages)


def number_pages(pages: DataFrame) -> DataFrame:
    """Number the pages of every document 1..n in input order.

    Page indexes are gathered in sorted blocks of at most ``PAGE_BLOCK``; a number is the place in the block
    plus the pages of the blocks before it. No task has to order all pages of one document, only its far fewer
    blocks, and the words are read once.
    """
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        pages.select("doc_id", "page_index", F.floor(F.col("page_index") / PAGE_BLOCK).alias("block"))
        .groupBy("doc_id", "block").agg(F.sort_array(F.collect_set("page_index")).alias("indexes"))
        .withColumn("before", F.coalesce(F.sum(F.size("indexes")).over(earlier), F.lit(0)))
    )
    return blocks.select("doc_id", "before", F.posexplode("indexes").alias("place", "page_index")).select(
        "doc_id", "page_index", (F.col("before") + F.col("place") + 1).cast("int").alias("page_num")
    )


def _with_page_list(words: DataFrame, pages: DataFrame | None, *columns: Column | str) -> DataFrame:
    """Word rows (``word`` is NULL for a blank one) and one wordless row for each entry of the page list."""
    rows = words.select(
        "doc_id", "page_index", "page_name", "pos",
        F.nullif(strip(F.col("text")), F.lit("")).alias("word"),
        F.col("conf").cast(_CONFIDENCE_SUM_TYPE).alias("conf"),
        *columns,
    )
    if pages is None:
        return rows
    wordless = pages.select("doc_id", "page_index", "page_name", F.lit(0).alias("pos"))
    return rows.unionByName(wordless, allowMissingColumns=True)


def _part() -> Column:
    return F.floor(F.col("pos") / PART_WORDS).alias("part")


def _words_and_confidence() -> tuple[Column, Column]:
    return (
        F.count("word").alias("token_count"),
        F.sum(F.when(F.col("word").isNotNull(), F.col("conf"))).alias("conf_sum"),
    )


# A part: the words of a document whose page indexes and positions lie in the same ranges.
_PART = ("doc_id", "page_group", "part")


def _gathered(rows: DataFrame, values: dict[str, Column], *others: Column) -> DataFrame:
    """One row per part with one array per value, in the order of arrival.

    Plain values of a column side by side take far less room in a shuffle than one record per word. A value is NULL in no
    row that is to be gathered and in all others, so that the arrays go together.
    """
    group = F.floor(F.col("page_index") / PAGE_GROUP).alias("page_group")
    arrays = [F.collect_list(value).alias(name) for name, value in values.items()]
    return rows.groupBy("doc_id", group, _part()).agg(*arrays, *others)


def _within(column: str, size: int, kind: str) -> Column:
    """The place of a page in its group or of a word in its part."""
    return F.coalesce(F.pmod(column, F.lit(size)), F.lit(0)).cast(kind)


def _page_index(page: Column, kind: DataType) -> Column:
    return (F.col("page_group") * PAGE_GROUP + page).cast(kind).alias("page_index")


_SUMS = ("token_count", "conf_sum")


def _word_parts(words: DataFrame, pages: DataFrame | None, named: bool = False, by_page: bool = False) -> DataFrame:
    """One row per part: the texts of its pages, its word count and confidence (``by_page``: each page's own, beside its text).

    The name goes with the page index; where an index has several names, each is a page of its own. Words move with a
    digest of the name of their page (``mark``), and each name once where it is wanted (``named``).
    """
    rows = _with_page_list(words, pages, F.coalesce("conf", F.lit(0.0)).alias("shown"))
    # A blank word moves as an empty text and keeps its page.
    values = {
        "page": _within("page_index", PAGE_GROUP, "tinyint"), "mark": F.xxhash64("page_name"),
        "place": _within("pos", PART_WORDS, "smallint"), "word": F.coalesce("word", F.lit("")),
    } | ({"shown": F.col("shown")} if by_page else {})
    names = [F.collect_set(F.struct(values["page"].alias("page"), "page_name")).alias("names")] if named else []
    parts = _gathered(rows, values, *names, *_words_and_confidence())
    entries = {name: F.col(name) for name in values}
    if named:  # behind the words
        entries["page"] = F.concat("page", "names.page")
        entries["mark"] = F.concat("mark", F.transform("names", lambda n: F.xxhash64(n["page_name"])))
        entries["page_name"] = F.concat(F.array_repeat(F.lit(None).cast("string"), F.size("word")), "names.page_name")
    each = parts.select(*_PART, *_SUMS, F.inline(F.arrays_zip(*entries.values())).alias(*entries)).withColumn("word", F.nullif("word", F.lit("")))
    sums = [F.first(name).alias(name) for name in _SUMS]
    if by_page:
        shown = F.when(F.col("word").isNotNull(), F.col("shown").cast(_CONFIDENCE_SUM_TYPE))
        sums = [F.count("word").alias("token_count"), F.sum(shown).alias("conf_sum")]
    texts = each.groupBy(*_PART, "page", "mark").agg(
        F.expr("listagg(word, ' ') WITHIN GROUP (ORDER BY place)").alias("part_text"),
        *([F.max("page_name").alias("page_name")] if named else []), *sums,
    )
    own = [*(["page_name"] if named else []), *(_SUMS if by_page else [])]
    return texts.groupBy(*_PART).agg(
        F.collect_list(F.struct("page", "mark", "part_text", *own)).alias("texts"),
        *[F.first(name).alias(name) for name in _SUMS if not by_page],
    )


def _pages_of(parts: DataFrame, kind: DataType) -> DataFrame:
    """One row per page of parts that are dealt by the document, or by the document and its groups of pages.

    What a part counts as a whole stands at one of its pages.
    """
    each = parts.select("*", F.posexplode("texts").alias("i", "found"))
    own = parts.schema["texts"].dataType.elementType.names
    sums = [(F.col(f"found.{n}") if n in own else F.when(F.col("i") == 0, F.col(n))).alias(n) for n in _SUMS]
    return (
        each.select(*_PART, _page_index(F.col("found.page"), kind), *[f"found.{n}" for n in own if n not in _SUMS], *sums)
        .groupBy("doc_id", "page_group", "page_index", "mark").agg(
            F.coalesce(F.expr("listagg(part_text, ' ') WITHIN GROUP (ORDER BY part)"), F.lit("")).alias("page_text"),
            *[F.sum(n).alias(n) for n in _SUMS], *[F.max(n).alias(n) for n in own if n == "page_name"],
        )
    )


def _pages_by_document(words: DataFrame, pages: DataFrame | None, named: bool = False) -> DataFrame:
    """The pages, dealt by document: the finished parts move once. The sums are right for whole documents only."""
    return _pages_of(_word_parts(words, pages, named).repartition("doc_id"), words.schema["page_index"].dataType)


def _mean_confidence(total: Column, count: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), count.cast("double")) / 100, F.lit(0.0))


def assemble_pages(words: DataFrame, pages: DataFrame | None = None, text_only: bool = False) -> DataFrame:
    """Text (words joined with one space), word count and mean confidence of every page.

    With ``text_only`` neither names nor counts nor confidences move, and the result has none of them.
    """
    parts = _word_parts(words, pages, named=not text_only, by_page=not text_only).repartition("doc_id", "page_group")
    found = _pages_of(parts, words.schema["page_index"].dataType)
    if text_only:
        return found.select("doc_id", "page_index", "page_text")
    return found.select(
        "doc_id", "page_index", "page_name", "page_text", "token_count",
        _mean_confidence(F.col("conf_sum"), F.col("token_count")).alias("avg_confidence"),
    )


def assemble_documents(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Text (pages joined with a newline, wordless pages included), page and word count, mean confidence.

    The mean runs over all words, not over page means. The finished parts move once, by document; the page
    step then needs no exchange of its own.
    """
    return (
        _pages_by_document(words, pages).groupBy("doc_id")
        .agg(
            F.expr("listagg(page_text, '\n') WITHIN GROUP (ORDER BY page_index)").alias("full_text"),
            F.count("*").alias("pages"),
            F.sum("token_count").alias("token_count"),
            F.sum("conf_sum").alias("conf_sum"),
        )
        .select(
            "doc_id", "full_text", "pages", "token_count",
            _mean_confidence(F.col("conf_sum"), F.col("token_count")).alias("avg_confidence"),
        )
    )


def page_statistics(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Word count and mean confidence of every page, without its text: numbers alone, in hash aggregates."""
    counted = _with_page_list(words, pages).groupBy("doc_id", "page_index", "page_name").agg(*_words_and_confidence())
    mean = _mean_confidence(F.col("conf_sum"), F.col("token_count"))
    return counted.select("doc_id", "page_index", "page_name", "token_count", mean.alias("avg_confidence"))


def fingerprint(pages: DataFrame, content: str = "page_text") -> DataFrame:
    """SHA-256 over the page contents of a document in lexicographic order of the page names.

    The digest runs over the whole document, so the contents meet in one row, like the document text.
    """
    joined = F.expr(f"listagg({content}, '') WITHIN GROUP (ORDER BY page_name)")
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.sha2(F.coalesce(joined, F.lit("")), 256).alias("checksum")
    )


def fingerprint_words(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The fingerprint straight from a word table; finished parts move once, by document."""
    return fingerprint(_pages_by_document(words, pages, named=True))


def ocr_results(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One nested result per page (``schemas.OCR_RESULT``): ordered tokens, text and page-wide statistics.

    Every page of the page list and of the word table has a record; a page without words has no tokens, an empty text
    and confidence 0. Tokens are gathered in parts, which move once, by document; a page, however long, is one record,
    so its tokens must fit one cell (2 GB). Words move as plain values and become records at the end. Pages are numbered where they meet, in the order of their index.
    """
    numbers = {f"_{name}": F.col(name) for name in ("conf", "left", "top", "width", "height")}
    rows = _with_page_list(words, pages, *[number.alias(name) for name, number in numbers.items()])
    # A number that is NULL moves as zero beside a bit, a blank word as an empty text: it keeps its page.
    bits = {name: 1 << i for i, name in enumerate(numbers)}
    missing = reduce(add, [F.when(F.col(name).isNull(), bit).otherwise(0) for name, bit in bits.items()]).cast("tinyint")
    plain = {name: F.coalesce(name, F.lit(0).cast(rows.schema[name].dataType)) for name in numbers}
    places = {"page": _within("page_index", PAGE_GROUP, "tinyint"), "place": _within("pos", PART_WORDS, "smallint")}
    values = places | {"word": F.coalesce("word", F.lit("")), "missing": missing} | plain
    each = _gathered(rows, values).repartition("doc_id").select(*_PART, F.inline(F.arrays_zip(*values)).alias(*values))
    written, shown = F.col("word") != "", F.when(F.col("missing").bitwiseAND(bits["_conf"]) == 0, F.col("_conf"))
    gathered = each.groupBy("doc_id", _page_index(F.col("page"), words.schema["page_index"].dataType)).agg(
        F.sort_array(F.collect_list(F.when(written, F.struct("part", "place", "word", *plain, "missing")))).alias("entries"),
        F.count_if(written).alias("token_count"), F.sum(F.when(written, shown.cast(_CONFIDENCE_SUM_TYPE))).alias("conf_sum"),
    )

    def token(entry: Column) -> Column:
        conf, left, top, width, height = (F.when(entry["missing"].bitwiseAND(bit) == 0, entry[name]) for name, bit in bits.items())
        box = F.array(left, top, left + width, top + height)
        return F.struct(entry["word"].alias("text"), (conf / 100).alias("confidence"), box.alias("bbox"), F.col("page_num"))

    numbered = gathered.withColumn("page_num", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")))
    return numbered.select(
        "doc_id", "page_num",
        F.transform("entries", token).alias("tokens"),
        F.array_join("entries.word", " ").alias("full_text"),
        F.struct(
            _mean_confidence(F.col("conf_sum"), F.col("token_count")).alias("avg_confidence"), "token_count"
        ).alias("metadata"),
    )
