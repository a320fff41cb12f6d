import re
from collections import Counter

from pyspark.sql import functions as F

from docfields.llm import quality
from tests_llm_help import ODD_ROWS, prose, rows_of


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    "a a a a a", "a b c a b c", "a b a b a b", "x", "x y", "x y z", "a b c d a b c e f a b c", "# * $ % & | < > #x", "l\nl\n \n l\nl",
    prose(1, 400) + "\n" + prose(1, 40), prose(2, 5000) + " " + prose(2, 300), "|".join("ab") * 60,
]


def test_measures_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *[r[1] for r in ODD_ROWS]])]
    found = quality.assess(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    for (_, text), row in zip(rows, found, strict=True):
        assert tuple(row[1:6]) == measures(text), text
        n, repeated = measures(text)[0], measures(text)[4]
        assert row.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (row.base_failed and row.kept)


def test_verdict_does_not_depend_on_the_order(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string")
    one = rows.select("doc_id", quality.first_failure(quality.RULES, F.col("text")).isNull().alias("kept"))
    other = rows.select("doc_id", quality.first_failure(quality.RULES[::-1], F.col("text")).isNull().alias("kept"))
    assert rows_of(one) == rows_of(other) == rows_of(quality.assess(rows).select("doc_id", "kept"))


def test_rules_are_ordered_by_rejections_per_cost(spark):
    rows = spark.createDataFrame([(i, prose(i, 80) + " #" * 40) for i in range(30)], "doc_id long, text string")
    found = quality.order_rules(rows)
    assert {e.rule.name for e in found} == {r.name for r in quality.RULES}
    rates = [e.rejected / e.seconds for e in found]
    assert rates == sorted(rates, reverse=True)
    assert found[0].rule.name in ("symbols", "not_words")
    assert [r.failed_rule for r in quality.cascade(rows).select("failed_rule").distinct().collect()] == [found[0].rule.name]


def test_the_plan_is_free_of_python(spark, odd):
    plan = quality.assess(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(odd, clashing, nothing):
    assert rows_of(quality.assess(odd)) == rows_of(quality.assess(clashing))
    assert quality.assess(nothing).count() == 0
    assert quality.cascade(clashing).count() == odd.count()
