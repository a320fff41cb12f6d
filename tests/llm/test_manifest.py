import hashlib
import zlib

import pytest

from docfields.llm import manifest
from tests_llm_help import ODD_ROWS, SCHEMA, prose


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return H(enc(doc_id), enc(source), enc(lang), enc(n_chars), enc(text))


def levels(nodes):
    """All levels of the tree over ``nodes``: pairs become their H, a lone last node its own H."""
    found = [list(nodes)]
    while len(found[-1]) > 1:
        level = found[-1]
        found.append([H(*level[i : i + 2]) for i in range(0, len(level), 2)])
    return found


def path_of(tree, index):
    path = []
    for level in tree[:-1]:
        sibling = index ^ 1
        path.append((level[sibling] if sibling < len(level) else None, index & 1 == 1))
        index >>= 1
    return path


def fold(start, path):
    for sibling, right in path:
        start = H(start) if sibling is None else H(sibling, start) if right else H(start, sibling)
    return start


def brute_force(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    inner = {}
    for lang in langs:
        ordered = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, leaf_of(r)))
        inner[lang] = (ordered, levels([leaf_of(r) for r in ordered]))
    top = levels([inner[lang][1][-1][0] for lang in langs])
    found = []
    for k, lang in enumerate(langs):
        ordered, tree = inner[lang]
        for i, row in enumerate(ordered):
            path = path_of(tree, i) + path_of(top, k)
            doc_id, text, _, source, n_chars = row
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            changed = leaf_of((doc_id, text, lang, source, n_chars + 1 if hit and n_chars is not None else n_chars))
            folded = fold(changed, path)
            proof = H("".join(s for s, _ in path if s is not None))
            found.append((doc_id, leaf_of(row), tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(found, key=repr)


def spark_rows(frame):
    keys = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[k] for k in keys) for r in manifest.manifest(frame).collect()), key=repr)


@pytest.mark.parametrize("levels_per_block", [1, 2, 10])
def test_equals_brute_force(spark, monkeypatch, levels_per_block):
    monkeypatch.setattr(manifest, "LEVELS_PER_BLOCK", levels_per_block)
    langs = ["en", "de", None, "fr", "é"]
    rows = [(i * 37 % 211, prose(i, i % 13), langs[i % 5] if i < 60 else "en", "s", 5 * i if i % 4 else None) for i in range(90)]
    rows += [tuple(r[:2]) + (r[2], r[3], r[4]) for r in ODD_ROWS]
    assert spark_rows(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)


def test_tampered_rows_fail_and_only_they(spark):
    rows = [(i, prose(i, 5), "en", "s", 10 + i) for i in range(200)]
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert {r.doc_id for r in found if not r.verified} == expected and len(found) == 200
    assert len({r.root for r in found}) == 1


def test_single_leaf_is_its_own_root(spark):
    row = manifest.manifest(spark.createDataFrame([(3, "a", "en", "s", 1)], SCHEMA)).first()
    assert row.leaf == row.subroot == row.root and row.path == []
    assert row.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_odd_rows(spark, odd, clashing, nothing):
    assert spark_rows(clashing) == brute_force([tuple(r) for r in ODD_ROWS])
    assert manifest.manifest(nothing).count() == 0
