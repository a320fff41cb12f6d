import random

import numpy as np
import pytest

from docfields.llm import near_dup
from tests_llm_help import ODD_ROWS, prose, rows_of


def weighted(text):
    words = (text or "").encode().split()
    width = min(len(words), 5)
    counts = {}
    for i in range(len(words) - width + 1 if words else 0):
        key = tuple(words[i : i + width])
        counts[key] = counts.get(key, 0) + 1
    return counts


def similarity(a, b):
    """The definition of J_P, term by term."""
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def brute_classes(rows):
    """Connected components of all pairs that are alike."""
    texts = {}
    for doc_id, text in rows:
        if doc_id is not None:
            texts[doc_id] = text
    sets = {i: weighted(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and find(i) != find(j) and similarity(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def variants(seed, count, words=120, edits=2):
    """A text and copies of it with a few words changed."""
    chooser = random.Random(seed)
    base = prose(seed, words).split()
    for _ in range(count):
        text = list(base)
        for _ in range(chooser.randrange(edits + 1)):
            text[chooser.randrange(words)] = f"new{chooser.randrange(10**6)}"
        yield " ".join(text)


def test_probability_jaccard_equals_its_definition():
    chooser = random.Random(3)
    for _ in range(60):
        a = " ".join(chooser.choice("abc") for _ in range(chooser.randrange(1, 40)))
        b = " ".join(chooser.choice("abc") for _ in range(chooser.randrange(1, 40)))
        found = near_dup.probability_jaccard(
            near_dup.weighted_shingles(near_dup.split_words(a)), near_dup.weighted_shingles(near_dup.split_words(b)))
        assert found == pytest.approx(similarity(weighted(a), weighted(b)))


def signature(text):
    hashes, counts = near_dup.weighted_shingles(near_dup.split_words(text))
    return near_dup.signatures(hashes, counts.astype(float), np.zeros(len(hashes), np.int32), 1)[0]


def test_signatures_estimate_the_similarity():
    agreed, expected = [], []
    for seed in range(80):
        a, b = variants(seed, 2, words=60, edits=6)
        agreed.append((signature(a) == signature(b)).mean())
        expected.append(similarity(weighted(a), weighted(b)))
    assert abs(np.mean(agreed) - np.mean(expected)) < 0.02
    assert np.corrcoef(agreed, expected)[0, 1] > 0.9


def test_texts_signed_together_or_alone_are_the_same():
    texts = [prose(i, n) for i, n in enumerate((1, 3, 7, 50, 400))]
    sets = [near_dup.weighted_shingles(near_dup.split_words(t)) for t in texts]
    owner = np.repeat(np.arange(5, dtype=np.int32), [len(s[0]) for s in sets])
    together = near_dup.signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float), owner, 5)
    for row, text in zip(together, texts, strict=True):
        assert (row == signature(text)).all()
        assert set(row.tolist()) <= set(near_dup.weighted_shingles(near_dup.split_words(text))[0].tolist())


def test_classes_equal_brute_force(spark):
    rows = [prose(1000 + i, 30 + i) for i in range(40)]
    rows += [t for seed in range(6) for t in variants(seed, 6)]
    rows += [prose(7, 90)] * 5 + list(variants(77, 40, words=150, edits=7)) + ["short text", "short  text", "one", "one two"]
    rows = [(i * 3 % 997, t) for i, t in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()}
    expected = brute_classes(rows)
    assert found.keys() == expected.keys()
    # Banding misses a pair at the threshold with a chance of 0.0002; nothing is linked that is not alike.
    assert sum(found[i] != expected[i] for i in expected) == 0


def test_members_unlike_their_centre_find_each_other(spark):
    """A bucket whose centre resembles one half only, and a chain that holds together by its neighbours only."""
    base = prose(5, 100).split()
    chain = []
    for step in range(12):
        base = [*base[4:], *prose(500 + step, 4).split()]
        chain.append(" ".join(base))
    rows = list(enumerate(chain))
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)
    assert set(found.values()) == {0}


@pytest.mark.parametrize("repeated", [False, True])
def test_copies_that_changed_in_different_places_are_not_all_compared(spark, monkeypatch, repeated):
    """A large group of copies, most of them unlike each other: comparisons grow with its members, and no link is lost."""
    chooser = random.Random(8)
    base = prose(9, 140).split()
    if repeated:
        base = base[:100] + base[:20] + base[100:]
    texts = []
    for _ in range(160):
        text = list(base)
        for _ in range(chooser.randrange(1, 9)):
            text[chooser.randrange(len(base))] = f"new{chooser.randrange(10**6)}"
        texts.append(" ".join(text))
    # Copies of changed copies resemble these, not the centre.
    for text in texts[:40]:
        text = text.split()
        text[chooser.randrange(len(text))] = "again"
        texts.append(" ".join(text))
    sets = [near_dup.weighted_shingles(near_dup.split_words(t)) for t in texts]
    links = [(j, i) for j in range(200) for i in range(j) if near_dup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9]
    least = list(range(200))
    for _ in least:
        for j, i in links:
            least[i] = least[j] = min(least[i], least[j])
    compared, verified = [], near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, docs: (compared.append(pairs.count()), verified(pairs, docs))[1])
    monkeypatch.setattr(near_dup, "GROWTH", 2)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()}
    assert found == dict(enumerate(least))
    assert len(set(least)) > 20
    assert sum(compared) < 200 * 15


def edited(seed, count, base, edits):
    """Copies of a text with words replaced, added or taken out, or the end cut off; some are changed copies of copies."""
    chooser = random.Random(seed)
    texts = []
    for _ in range(count):
        text = list(chooser.choice(texts).split() if texts and chooser.random() < 0.3 else base)
        for _ in range(chooser.randrange(edits + 1)):
            at, word = chooser.randrange(len(text)), f"new{chooser.randrange(10**6)}"
            chooser.choice((lambda: text.__setitem__(at, word), lambda: text.insert(at, word), lambda: text.pop(at)))()
        if chooser.random() < 0.15:
            text = text[: len(text) - chooser.randrange(20)]
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("repeated", [0, 1, 3])
def test_split_buckets_lose_no_link(spark, repeated):
    """Texts of many lengths in one bucket, with no, a few or only repeated shingles, split from the first round on."""
    base = prose(19, 110).split()
    texts = edited(11, 170, base + base[:20] if repeated == 3 else base, 7)
    if repeated:
        texts += edited(12, 10, base + base[10:30], 5)
    sets = [near_dup.weighted_shingles(near_dup.split_words(t)) for t in texts]
    assert sum(bool((s[1] > 1).any()) for s in sets) > (0, 5, 150, 150)[repeated] or not repeated
    one = spark.createDataFrame([(7, 0, i, 1, 1 - near_dup.probability_jaccard(sets[i], sets[0])) for i in range(1, len(texts))],
                                "bucket long, centre long, member long, degree long, distance double")
    placed = one.distance <= 0.2 + 1e-9
    state = one.selectExpr("*", "distance <= 0.2 + 1e-9 placed", "if(distance <= 0.2 + 1e-9, 0L, member) `group`", "true short",
                           "1L total", "0L before", "0L up", "0L down", "false regular", "false mixed")
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {tuple(r) for r in near_dup._all_pairs(near_dup._split(state, documents)).distinct().collect()}
    free = {r.member for r in one.filter(~placed).collect()}
    links = {
        (i, j) for j in range(1, len(texts)) for i in range(1, j)
        if (i in free or j in free) and near_dup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9
    }
    assert len(free) > 20 and len(links) > 50
    assert links <= found


def test_placed_copies_do_not_meet_in_what_they_lack(spark, monkeypatch):
    """In a large group of copies with words replaced, only what changed alike shares a bucket; before, all that lost the same did."""
    chooser = random.Random(4)
    base = prose(29, 150).split()
    texts = [" ".join(base)]
    for _ in range(500):
        text = list(base)
        for at in chooser.sample(range(5, 145), chooser.choice((1, 2, 3, 5, 6, 7))):
            text[at] = f"new{chooser.randrange(10**7)}"
        texts.append(" ".join(text))
    split, sizes = near_dup._split, []
    monkeypatch.setattr(near_dup, "_split", lambda *a: (rows := split(*a), sizes.append(near_dup._open(rows).count()))[0])
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(documents).collect()}
    assert len(set(found.values())) > 50
    assert sizes and max(sizes) < 2000


def test_components(spark):
    chooser = random.Random(1)
    edges = [(i, i - 1) for i in range(1, 30)] + [(100 + i, 100) for i in range(1, 50)] + [(chooser.randrange(200, 260), chooser.randrange(200, 260)) for _ in range(40)]
    found = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "member long, centre long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert found == {i: find(i) for a, b in edges if a != b for i in (a, b)}


@pytest.mark.parametrize("named", [False, True])
def test_long_paths_take_few_rounds(spark, monkeypatch, named):
    """Edges that are read together are joined before the first round; a path of 400 nodes took 33 tables before."""
    names, stored = [], near_dup.stored
    monkeypatch.setattr(near_dup, "stored", lambda frame, name: (names.append(name), stored(frame, name))[1])
    order = random.Random(6).sample(range(400), 400)
    edges = [(f"n{a:03}", f"n{b:03}") if named else (a, b) for a, b in zip(order[1:], order, strict=False)]
    edges += [edges[0], edges[0][::-1], (edges[0][0],) * 2]
    kind = "string" if named else "long"
    table = spark.createDataFrame(edges, f"member {kind}, centre {kind}").coalesce(1)
    found = {r.node: r.component for r in near_dup.components(table).collect()}
    assert found == {f"n{i:03}" if named else i: "n000" if named else 0 for i in range(400)}
    assert len(names) <= 6


def test_odd_rows(odd, clashing, nothing):
    found = near_dup.near_duplicates(odd)
    assert rows_of(found) == rows_of(near_dup.near_duplicates(clashing))
    classes = {r.doc_id: r.class_id for r in found.collect()}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 4, None: None, 5: 5, 6: 6, 7: 7, 8: 4}
    assert found.count() == len(ODD_ROWS)
    assert near_dup.near_duplicates(nothing).count() == 0
    kept = near_dup.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 3, 4, 4, 5, 6, 7, None, None]
