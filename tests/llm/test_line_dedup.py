from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docfields.llm import line_dedup
from tests_llm_help import prose, rows_of


def brute(rows, ratio, least):
    pages, on = Counter(), defaultdict(Counter)
    for _, site, text in rows:
        pages[site] += 1
        on[site].update({line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")})
    found = []
    for doc_id, site, text in rows:
        lines = (text or "").split("\n")
        kept = [li for li in lines if not (on[site][li] >= least and on[site][li] > ratio * pages[site])]
        found.append((doc_id, text if len(kept) == len(lines) else "\n".join(kept), 0 if text is None else len(lines), len(lines) - len(kept)))
    return sorted(found, key=repr)


def test_equals_brute_force(spark):
    rows = []
    for i in range(300):
        site = "hot" if i % 3 else ("cold", None, "rare")[i % 9 // 3]
        lines = [prose(i, 5)] + (["menu home"] if i % 2 else []) + (["once in a while"] if i % 40 == 0 else []) + ["", prose(i % 7, 4)]
        rows.append((i, site, None if i % 50 == 49 else "\n".join(lines)))
    table = spark.createDataFrame(rows, "doc_id long, site string, text string")
    for ratio, least in ((0.02, 5), (0.4, 2), (0.0, 1)):
        found = line_dedup.drop_boilerplate(table, F.col("site"), ratio=ratio, min_pages=least).select("doc_id", "cleaned.*")
        assert rows_of(found) == brute(rows, ratio, least)


def test_hosts(spark):
    urls = ["http://A.example.com/x", "https://u:p@b.org:80/y", "ftp://c", "no address", None, "http:///x"]
    table = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    assert [r[0] for r in table.orderBy("i").select(line_dedup.host(F.col("url"))).collect()] == [
        "a.example.com", "b.org", "c", None, None, None]


def test_odd_rows(odd, clashing, nothing):
    found = line_dedup.drop_boilerplate(odd, F.col("source"), min_pages=2)
    assert found.columns == [*odd.columns, "cleaned"] and found.count() == odd.count()
    assert line_dedup.drop_boilerplate(nothing, F.col("source")).count() == 0
    other = line_dedup.drop_boilerplate(clashing, F.col("source"), min_pages=2, into="own")
    assert rows_of(other.select("doc_id", "own.*")) == rows_of(found.select("doc_id", "cleaned.*"))


def test_the_plan_is_free_of_python(odd):
    plan = line_dedup.drop_boilerplate(odd, F.col("source"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_copies_count_once_on_request(spark):
    copied = prose(1, 9) + "\n" + prose(2, 9)
    rows = [(i, "a", copied) for i in range(20)] + [(i, "a", f"menu home\n{prose(i, 9)}") for i in range(20, 28)] + [(28, "a", None)] * 2
    table = spark.createDataFrame(rows, "doc_id long, site string, text string")
    found = line_dedup.drop_boilerplate(table, F.col("site"), ratio=0.5, copies_once=True).collect()
    assert len(found) == len(rows)
    for row in found:
        expected = row.text.removeprefix("menu home\n") if row.text else None
        assert row.cleaned.text == expected
