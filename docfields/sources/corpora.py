"""Labelled documents rendered from business tables.

Every corpus has the columns ``doc_id, doc_type, text, truth``; the truth maps field names to the values that
the document should show. Invoices and ID cards can be rendered with planted defects, which depend on the
key only, so that each kind of extraction and validation outcome occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Documents that one task renders.
TASK_DOCUMENTS = 25_000


def _cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _money(cents: Column) -> Column:
    whole, rest = F.floor(cents / 100).cast("string"), (cents % 100).cast("string")
    return F.concat(whole, F.lit("."), F.lpad(rest, 2, "0"))


def _money_with_comma(cents: Column) -> Column:
    whole, rest = F.floor(cents / 100), (cents % 100).cast("string")
    thousands, units = F.floor(whole / 1000).cast("string"), (whole % 1000).cast("string")
    text = F.concat(thousands, F.lit(","), F.lpad(units, 3, "0"), F.lit("."), F.lpad(rest, 2, "0"))
    return F.when(whole >= 1000, text).otherwise(_money(cents))


def _tax(cents: Column) -> Column:
    return F.floor((cents * 8 + 50) / 100)


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _text(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def _truth(**values: Column) -> Column:
    return F.create_map(*[c for name, value in values.items() for c in (F.lit(name), value)])


def _spread(table: DataFrame, key: str, rows: int) -> DataFrame:
    """The table dealt by a key so that a task renders about ``TASK_DOCUMENTS`` documents of ``rows``.

    A row of a few bytes becomes a document of dozens of words: partitions sized by the bytes of the rows would be few,
    and hold millions of words each. Tables of a few tasks' worth stay as they are read.
    """
    tasks = -(-rows // TASK_DOCUMENTS)
    return table if tasks <= 1 else table.repartition(max(tasks, table.sparkSession.sparkContext.defaultParallelism), key)


def _corpus(table: DataFrame, doc_id: Column, doc_type: str, text: Column, truth: Column) -> DataFrame:
    return table.select(
        doc_id.alias("doc_id"), F.lit(doc_type).alias("doc_type"), text.alias("text"), truth.alias("truth")
    )


def invoices(orders: DataFrame, lineitem: DataFrame, defects: bool = True) -> DataFrame:
    """One invoice per order with line items.

    Line items are summed before the join, so an order with very many of them is combined on the map side and
    the join is one to one.
    """
    sums = lineitem.groupBy("l_orderkey").agg(F.sum(_cents(F.col("l_extendedprice"))).alias("sub"))
    table = orders.join(sums, orders["o_orderkey"] == sums["l_orderkey"]).select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), "sub",
        _tax(F.col("sub")).alias("tax"),
    )
    table = _spread(table, "k", orders.count())
    k, day, sub, tax = F.col("k"), F.col("day"), F.col("sub"), F.col("tax")
    total = sub + tax

    def planted(modulus: int) -> Column:
        return (k % modulus == 0) if defects else F.lit(False)

    number = F.when(planted(31), "").when(planted(11), _text("-", k)).otherwise(_text("INV-", k))
    issued = (
        F.when(planted(37), F.date_format(day, "dd/MM/yy"))
        .when(planted(7), F.date_format(day, "dd/MM/yyyy"))
        .otherwise(_iso(day))
    )
    due = F.when(planted(13), F.date_sub(day, 5)).otherwise(F.date_add(day, 30))
    sub_label = F.when(planted(29), "Sub-Total: $").when(planted(19), "Sub Total: $").otherwise("Subtotal: $")
    shown = total + F.when(planted(17), 100).otherwise(0) + F.when(planted(41), 2).otherwise(0)
    shown_text = F.when(planted(43), _money_with_comma(shown)).otherwise(_money(shown))
    tax_id = _text("12-", 1000000 + k % 9000000)
    text = _lines(
        _text("Invoice Number: ", number),
        _text("Invoice Date: ", issued),
        _text("Due Date: ", _iso(due)),
        _text(sub_label, _money(sub)),
        F.when(~(planted(23) | planted(47)), _text("Tax: $", _money(tax))),
        _text("Total: $", shown_text),
        _text(F.when(planted(47), "Tax ID ").otherwise("Tax ID: "), tax_id),
        _text("Routing Number: ", 100000000 + k),
        _text("Account Number: ", 1000000000 + k),
    )
    truth = _truth(
        invoice_number=_text("INV-", k),
        invoice_date=_iso(day),
        due_date=_iso(F.date_add(day, 30)),
        subtotal_amount=_money(sub),
        tax_amount=F.when(~planted(47), _money(tax)),
        total_amount=_money(total),
        tax_id=tax_id,
        routing_number=(100000000 + k).cast("string"),
        bank_account=(1000000000 + k).cast("string"),
    )
    return _corpus(table, _text("invoice-", k), "invoice", text, truth)


def id_cards(customer: DataFrame, defects: bool = True) -> DataFrame:
    """One identity card per customer; the truth has no machine-readable zone."""
    k = F.col("c_custkey")
    birth = F.date_add(F.lit("1960-01-01").cast("date"), ((k * 37) % 14000).cast("int"))
    expiry = F.date_add(F.lit("2026-01-01").cast("date"), ((k * 53) % 3650).cast("int"))
    title, shown_expiry, length = F.lit("IDENTIFICATION CARD"), expiry, F.lit(29)
    if defects:
        title = F.when(k % 7 == 0, None).when(k % 5 == 0, "PASSPORT").otherwise(title)
        shown_expiry = F.when(k % 17 == 0, F.date_sub(birth, 30)).otherwise(expiry)
        length = F.when(k % 3 == 0, 29).when(k % 3 == 1, 30).otherwise(44)
    name = F.replace(F.upper("c_name"), F.lit("#"), F.lit("<"))
    number = _text("ID-", 100000 + k)
    text = _lines(
        title,
        _text("ID Number: ", number),
        _text("Date of Birth: ", _iso(birth)),
        _text("Expiry: ", _iso(shown_expiry)),
        F.rpad(_text("P<EXA", name), 30, "<"),
        F.rpad(_text("L", F.lpad(k.cast("string"), 9, "0")), length, "<"),
    )
    truth = _truth(id_number=number, birth_date=_iso(birth), expiry_date=_iso(expiry))
    return _corpus(_spread(customer, "c_custkey", customer.count()), _text("id-", k), "id_card", text, truth)


def tax_forms(supplier: DataFrame) -> DataFrame:
    """One tax form per supplier."""
    k = F.col("s_suppkey")
    total = F.abs(_cents(F.col("s_acctbal")))
    tax_id, routing = _text("98-", 1000000 + k), (100000000 + k).cast("string")
    text = _lines(
        F.lit("Form 1040"),
        _text("Tax ID: ", tax_id),
        _text("Tax Amount: $", _money(_tax(total))),
        _text("Total: $", _money(total)),
        _text("Routing No.: ", routing),
    )
    truth = _truth(
        tax_id=tax_id, tax_amount=_money(_tax(total)), total_amount=_money(total), routing_number=routing
    )
    return _corpus(_spread(supplier, "s_suppkey", supplier.count()), _text("tax-", k), "tax_form", text, truth)


def plain_documents(documents: DataFrame) -> DataFrame:
    """Documents of no known kind: nothing to extract, an empty truth."""
    empty = F.create_map().cast("map<string,string>")
    return _corpus(documents, _text("doc-", F.col("doc_id")), "unknown", F.col("text"), empty)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices, identity cards and tax forms of one table folder."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    return (
        invoices(table("orders"), table("lineitem"))
        .unionByName(id_cards(table("customer")))
        .unionByName(tax_forms(table("supplier")))
    )


def everything(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled documents and the plain ones."""
    return labelled(spark, folder).unionByName(plain_documents(spark.read.parquet(f"{folder}/documents.parquet")))


def truth_table(corpus: DataFrame) -> DataFrame:
    """The truth as a separate long table (doc_id, name, value)."""
    return corpus.select("doc_id", F.explode("truth").alias("name", "value")).filter(F.col("value").isNotNull())


def words_of(corpus: DataFrame) -> DataFrame:
    """A word table as a recogniser would give it for the documents of a corpus; every token of a text is in it.

    Twelve words make a page, and positions count within it. Every fifth word is padded, every ninth word is followed
    by a blank one, and after every fourth page of words comes a page with one blank word only.
    """
    order = F.col("order")
    written = F.floor(order / 12).cast("int")
    padded = F.when(order % 5 == 0, F.concat(F.lit("  "), F.col("token"), F.lit("\t"))).otherwise(F.col("token"))

    def entry(text: Column, blank_page: bool, extra: int) -> Column:
        return F.struct(text.alias("text"), F.lit(int(blank_page)).alias("blank_page"), F.lit(extra).alias("extra"))

    word, blank, page = entry(padded, False, 0), entry(F.lit(" "), False, 1), entry(F.lit(" "), True, 0)
    opens_blank_page = order % 48 == 47
    entries = (
        F.when((order % 9 == 0) & opens_blank_page, F.array(word, blank, page))
        .when(order % 9 == 0, F.array(word, blank))
        .when(opens_blank_page, F.array(word, page))
        .otherwise(F.array(word))
    )
    # Four written pages, then a blank one.
    page_index = written + F.floor(written / 4).cast("int") + F.col("blank_page")
    return (
        corpus.select("doc_id", F.posexplode(F.split("text", r"[ \t\r\n]+")).alias("order", "token"))
        .select("doc_id", "order", F.inline(entries))
        .select("doc_id", "order", "text", "extra", "blank_page", page_index.alias("page_index"))
        .select(
            "doc_id",
            F.concat(F.lit("page"), F.col("page_index")).alias("page_name"),
            "page_index",
            F.when(F.col("blank_page") == 1, F.lit(0)).otherwise(order % 12 * 2 + F.col("extra")).cast("int").alias("pos"),
            "text",
            (50 + (order * 7) % 50).cast("double").alias("conf"),
            ((order % 12) * 40).alias("left"),
            (F.floor(order / 12) * 20).cast("int").alias("top"),
            (8 * F.length("text")).alias("width"),
            F.lit(16).alias("height"),
        )
    )
