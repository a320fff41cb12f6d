"""Extraction quality against labelled truth.

Truth comes in one of two forms. On labelled documents it is a map next to the text, and pairing it with the
extracted fields is a projection (``pair_documents``). As a separate table it has to be joined (``pair_tables``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields import rules
from docfields.functions.ratios import ratio, round_half_even
from docfields.functions.text import strip
from docfields.operators.validate import summarize


def comparable(value: Column) -> Column:
    """Form in which values are compared: stripped, lower case, no commas, empty for NULL."""
    return F.replace(F.lower(strip(F.coalesce(value, F.lit("")))), F.lit(","), F.lit(""))


def _status(gt: Column, pred: Column) -> Column:
    return (
        F.when((gt != "") & (gt == pred), "tp")
        .when((gt != "") & (pred != ""), "wrong")
        .when(gt != "", "missed")
        .when(pred != "", "spurious")
    )


def _judged(pairs: DataFrame) -> DataFrame:
    return (
        pairs.withColumns({"gt": comparable(F.col("gt")), "pred": comparable(F.col("pred"))})
        .withColumn("status", _status(F.col("gt"), F.col("pred")))
        .filter(F.col("status").isNotNull())
    )


def pair_tables(truth: DataFrame, predicted: DataFrame, order: str | None = None) -> DataFrame:
    """Pair two long tables (doc_id, name, value) over the union of their names per document.

    Each side is folded into one map per document first, so documents and not values are joined. Where a name comes
    more than once in a document, the last one wins, as when a dict is filled in order: the one with the largest
    ``order`` column, or without such a column the largest value (ties of ``order`` go to the larger value too).
    Rows without a name pair nothing. The fold sorts each document's entries once and keeps the last of every name.
    """
    def folded(table: DataFrame, column: str) -> DataFrame:
        rank = F.col(order) if order and order in table.columns else F.col("value")
        # The plain order of the entries: a comparator would be called for every pair of them.
        entries = F.sort_array(F.collect_list(F.struct("name", rank.alias("rank"), "value")))
        last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["name"] != e["name"], F.lit(True)))
        named = table.filter(F.col("name").isNotNull())
        return named.groupBy("doc_id").agg(F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], e["value"]))).alias(column))

    none = F.create_map().cast("map<string,string>")
    both = folded(truth, "gt_values").join(folded(predicted, "pred_values"), "doc_id", "full_outer").select(
        "doc_id", F.coalesce("gt_values", none).alias("gt_values"), F.coalesce("pred_values", none).alias("pred_values")
    )
    names = F.array_union(F.map_keys("gt_values"), F.map_keys("pred_values"))
    pairs = F.transform(names, lambda n: F.struct(
        n.alias("name"), F.try_element_at("gt_values", n).alias("gt"), F.try_element_at("pred_values", n).alias("pred")))
    return _judged(both.select("doc_id", F.explode_outer(pairs).alias("pair")).select("doc_id", "pair.*"))


def _unknown_names(truth: Column) -> Column:
    return F.array_except(F.map_keys(truth), F.array(*[F.lit(name) for name in rules.ALL_FIELDS]))


def _unknown_pairs(truth: Column, names: Column) -> Column:
    return F.transform(
        names, lambda n: F.struct(n.alias("name"), truth[n].alias("gt"), F.lit(None).cast("string").alias("pred"))
    )


def _pairs(truth: Column) -> Column:
    """Array of (name, gt, pred) over the union of the names in the truth map and the rule set."""
    known = F.array(
        *[
            F.struct(F.lit(name).alias("name"), truth[name].alias("gt"), F.col(name).alias("pred"))
            for name in rules.ALL_FIELDS
        ]
    )
    # Names that no rule can give are rare, so they are looked at only where the truth has one.
    unknown = _unknown_names(truth)
    return F.when(F.size(unknown) > 0, F.concat(known, _unknown_pairs(truth, unknown))).otherwise(known)


def pair_documents(extracted: DataFrame, truth: str = "truth") -> DataFrame:
    """Pair the truth map of every document with its extracted fields; no row moves.

    The outer explode infers no filter from its input, which would build the pairs twice.
    """
    pairs = extracted.select("doc_id", F.explode_outer(_pairs(F.col(truth))).alias("pair"))
    return _judged(pairs.select("doc_id", "pair.*"))


def pairs_of_records(stored: DataFrame) -> DataFrame:
    """The judged pairs inside stored sample records."""
    fields = stored.select("doc_id", F.explode("fields").alias("name", "field"))
    return fields.select("doc_id", "name", "field.*")


def count_outcomes(pairs: DataFrame) -> DataFrame:
    """True positives, false positives and false negatives per field; a wrong value is both of the latter."""
    status = F.col("status")
    return pairs.groupBy("name").agg(
        F.count_if(status == "tp").alias("tp"),
        F.count_if(status.isin("wrong", "spurious")).alias("fp"),
        F.count_if(status.isin("wrong", "missed")).alias("fn"),
    )


def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.col("precision"), F.col("recall")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}).withColumn(
        "f1", ratio(2 * precision * recall, precision + recall)
    )


def field_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every field, unrounded."""
    return _scores(counts)


def micro_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 over the summed counts; zeros if nothing was counted."""
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return _scores(totals)


def rounded(metrics: DataFrame, digits: int = 3) -> DataFrame:
    """Metrics as they are reported."""
    return metrics.withColumns({c: round_half_even(F.col(c), digits) for c in ("precision", "recall", "f1")})


def report(counts: DataFrame) -> DataFrame:
    """Rounded metrics per field in name order."""
    return (
        rounded(field_metrics(counts)).withColumnRenamed("name", "field")
        .select("field", "tp", "fp", "fn", "precision", "recall", "f1").orderBy("field")
    )


def sample_count(documents: DataFrame) -> DataFrame:
    """Number of evaluated documents, those without any field included."""
    return documents.agg(F.count("*").alias("n_samples"))


def sample_records(checked: DataFrame, truth: str = "truth", true_type: str = "doc_type_truth") -> DataFrame:
    """One record per document: types, judged fields, errors and warnings; no row moves.

    Known names are judged as columns; only names that no rule can give take the path for any name.
    """

    def judge(pair: Column) -> Column:
        gt, pred = comparable(pair["gt"]), comparable(pair["pred"])
        return F.struct(pair["name"], F.struct(gt.alias("gt"), pred.alias("pred"), _status(gt, pred).alias("status")))

    names = rules.ALL_FIELDS
    sides = {f"_gt_{name}": comparable(F.col(truth)[name]) for name in names}
    sides |= {f"_pred_{name}": comparable(F.col(name)) for name in names}
    status = {f"_status_{name}": _status(F.col(f"_gt_{name}"), F.col(f"_pred_{name}")) for name in names}
    known = F.array(*[
        F.when(F.col(f"_status_{name}").isNotNull(), F.struct(
            F.lit(name).alias("name"),
            F.struct(*[F.col(f"_{side}_{name}").alias(side) for side in ("gt", "pred", "status")]).alias("col2"),
        )) for name in names
    ])
    present = F.filter(known, lambda e: e.isNotNull())
    unknown = _unknown_names(F.col(truth))
    others = F.filter(F.transform(_unknown_pairs(F.col(truth), unknown), judge), lambda e: e["col2"]["status"].isNotNull())
    judged = F.when(F.size(unknown) > 0, F.concat(present, others)).otherwise(present)
    compared = checked.withColumns(sides).withColumns(status)
    return summarize(compared.withColumn("fields", F.map_from_entries(judged))).select(
        "doc_id",
        F.col("doc_type").alias("doc_type_predicted"),
        F.col(true_type).alias("doc_type_truth"),
        "fields",
        F.col("errors").alias("validation_errors"),
        F.col("warnings").alias("validation_warnings"),
    )
