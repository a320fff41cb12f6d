import hashlib
from fractions import Fraction

import pytest

from docfields.llm import mixing
from tests_llm_help import rows_of


def fair_targets(sizes, weights=(1, 2, 3), limit=3):
    """Deals the budget by weight, cuts at the limits and deals the excess again until nothing is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: Fraction(weights[i % len(weights)]) for i, n in enumerate(names)}
    budget, capped = Fraction(sum(sizes.values())), {}
    while True:
        free = [n for n in names if n not in capped]
        left = budget - sum(capped.values())
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > limit * sizes[n]]
        if not over:
            return {**capped, **share}
        capped.update({n: Fraction(limit * sizes[n]) for n in over})


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 10, "c": 10_000}, {"c": 5, "b": 100_000, None: 7, "a": 3},
        {"a": 0, "b": 50}, {"x": 1}, {"a": 1, "b": 1, "c": 1, "d": 1000, "e": 1, "f": 1, "g": 1000},
    ],
)
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    expected = fair_targets(sizes)
    assert found.keys() == expected.keys()
    for name, value in expected.items():
        assert found[name] == pytest.approx(float(value), rel=1e-12)


def brute_mix(rows):
    sizes, queues = {}, {}
    for doc_id, text, source in rows:
        size = len((text or "").encode().split())
        sizes[source] = sizes.get(source, 0) + size
        key = hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()
        queues.setdefault(source, []).append((key, doc_id or 0, size, doc_id))
    targets = fair_targets(sizes)
    copies, spots = [], []
    for source, queue in queues.items():
        position = 0
        for _, _, size, doc_id in sorted(queue, key=lambda e: e[:3]):
            position += size
            finishes = [float(n * sizes[source] + position) / float(targets[source]) for n in range(3)] if size else []
            copies += [(f, size) for f in finishes]
            spots.append((doc_id, size, finishes))
    budget, total, cut = sum(sizes.values()), 0, -1.0
    for finish in sorted({f for f, _ in copies}):
        total += sum(s for f, s in copies if f == finish)
        if total > budget:
            break
        cut = finish
    return sorted(((d, s, s * sum(f <= cut for f in fs)) for d, s, fs in spots), key=str), targets


def test_mix_equals_brute_force(spark):
    rows = [(i, " ".join("w" * (1 + i * 7 % 23)), ("s0", "s1", "s2", None)[(i % 10) // 3]) for i in range(300)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    expected, targets = brute_mix(rows)
    assert sorted(((r.doc_id, r.size, r.taken) for r in found.collect()), key=str) == expected
    taken = {}
    for r in found.collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    for source, target in targets.items():
        assert abs(taken[source] - float(target)) <= 2 * 23


def test_odd_rows(spark, odd, clashing, nothing):
    found = mixing.mix(odd)
    assert found.count() == odd.count()
    assert {(r.doc_id, r.size, r.taken) for r in found.collect() if r.size == 0} == {
        (1, 0, 0), (2, 0, 0), (3, 0, 0), (None, 0, 0)}
    assert rows_of(found) == rows_of(mixing.mix(odd)) == rows_of(mixing.mix(clashing))
    assert mixing.mix(nothing).count() == 0
    repeated = mixing.repeated(clashing)
    assert repeated.columns == clashing.columns
    assert mixing.repeated(nothing).count() == 0
