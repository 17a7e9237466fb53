"""Locally consistent parsing against a scalar parse, over shifted passages, and the whole query against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from quayside.llm import locally_consistent as lcp
from quayside.llm import queries

from .conftest import SCHEMA, prose

MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_level(names):
    """One level of one text, a name at a time: [(start, name)]."""
    c = 0x9E3779B97F4A7C15
    runs, at = [], 0
    while at < len(names):
        end = at
        while end < len(names) and names[end] == names[at]:
            end += 1
        runs.append((at, names[at] if end - at == 1 else mixed((names[at] + c * (end - at)) & MASK)))
        at = end
    labels = [n for _, n in runs]
    for _ in range(4):
        new = []
        for i, x in enumerate(labels):
            place = 0 if i == 0 else (((x ^ labels[i - 1]) & -(x ^ labels[i - 1])).bit_length() - 1)
            new.append(2 * place + (x >> place & 1))
        labels = new
    assert all(v < 6 for v in labels) and all(a != b for a, b in zip(labels, labels[1:]))
    starts = [i for i in range(len(runs)) if i == 0 or (0 < i < len(runs) - 1 and labels[i - 1] < labels[i] > labels[i + 1])]
    out = []
    for a, b in zip(starts, [*starts[1:], len(runs)]):
        total = sum(mixed((runs[i][1] + c * (i - a + 1)) & MASK) for i in range(a, b)) + (b - a)
        out.append((runs[a][0], mixed(total & MASK)))
    return out


def plain_phrases(text):
    names, places, out = [mixed(ord(ch)) for ch in text], list(range(len(text))), []
    while names and (not out or len(names) > 1):
        level = plain_level(names)
        places, names = [places[s] for s, _ in level], [n for _, n in level]
        out.append((places, names))
    return out


TEXTS = ["", "a", "ab", "aaaa", "aaaaaaaab", "abababababababab", "One two three.", "naïve 😀😀😀 中文中文", prose(1), prose(2, 900), "x" * 5000, "ab " * 700, ". , ! ?"]


@pytest.mark.parametrize("text", TEXTS)
def test_parse_equals_the_scalar_one(text):
    assert lcp.phrases(text) == plain_phrases(text)
    if text:
        root = lcp.phrases(text)[-1][1]
        assert len(root) == 1 and lcp.fingerprints([text])[0, :8].tobytes() == root[0].to_bytes(8, "big")


def test_many_texts_at_once_equal_one_by_one(monkeypatch):
    r = random.Random(3)
    texts = [t for k in range(40) for t in (prose(k, r.randint(1, 300)), r.choice(TEXTS))]
    alone = np.concatenate([lcp.fingerprints([t]) for t in texts])
    for characters in (1, 500, 1 << 20):
        monkeypatch.setattr(lcp, "CHARACTERS", characters)
        assert (lcp.fingerprints(texts) == alone).all()


def test_equal_passages_share_their_interior_phrases():
    passage = prose(5, 400)
    for level in range(3):
        found = []
        for before, after in (("", ""), ("Q", "!"), (prose(6, 31), prose(7, 17)), ("x" * 77, "")):
            starts, names = lcp.phrases(before + passage + after)[level]
            inner = [(s - len(before), n) for s, n in zip(starts, names) if 150 <= s - len(before) < len(passage) - 300]
            found.append(inner)
        assert len(found[0]) > 10 and all(f == found[0] for f in found)


def test_likeness():
    base = prose(9, 500)
    f = lcp.fingerprints([base, base, base + " and a little more", prose(10, 500), "", ""])
    assert lcp.likeness(f[:1], f[1:2])[0] == 1 and lcp.likeness(f[4:5], f[5:6])[0] == 1
    assert lcp.likeness(f[:1], f[2:3])[0] > 0.8 and lcp.likeness(f[:1], f[3:4])[0] < 0.3 and lcp.likeness(f[:1], f[4:5])[0] == 0
    assert lcp.likeness_of(f[0].tobytes().hex(), f[2].tobytes().hex()) == lcp.likeness(f[:1], f[2:3])[0]


def expected(rows):
    """rows of (doc_id, text) in the order of documents."""
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        own, other, following = (lcp.fingerprints([t]) for t in (text, changed, after))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((i, len(text), sha, own.tobytes().hex(), other.tobytes().hex(), lcp.likeness(own, other)[0], lcp.likeness(own, following)[0]))
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    got = sorted(map(tuple, queries.QUERIES["op11_locally_consistent_fingerprints"](spark, path).collect()))
    assert got == sorted(expected(rows))
    different = [r for r in got if r[1] >= 300 and r[6] < 0.5]
    assert sum(r[5] > r[6] for r in different) >= 0.99 * len(different) and np.median([r[5] for r in different]) > 0.5


def test_awkward_documents(spark, docs, no_docs):
    assert lcp.compare_with_edits(no_docs).count() == 0
    got = lcp.compare_with_edits(docs).collect()
    assert len(got) == docs.count() and len({r.fingerprint for r in got if r.doc_id == 6}) == 1
    again = {tuple(r) for r in lcp.compare_with_edits(docs.repartition(7)).collect()}
    assert again == {tuple(r) for r in got}
    (alone,) = lcp.compare_with_edits(spark.createDataFrame([(4, "Just one text.", "", "", 0, "", 0, "", "")], SCHEMA)).collect()
    assert alone.near_next == 1 and alone.n_chars == 14


def test_hot_ids_and_copies(spark):
    """A third of the rows have no id, a third are one row; every row still has the next of the whole order."""
    rows = [(None, f"text {k % 7} of none") for k in range(60)] + [(5, "the same row")] * 60 + [(k, f"text number {k}") for k in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in lcp.compare_with_edits(df).collect()))
    hashed = {t: h for t, h in df.selectExpr("text", "xxhash64(text)").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    assert got == sorted((i is not None, i or 0, n, sha) for i, n, sha, *_ in expected(order))


def test_column_of_fingerprints(spark, docs):
    found = lcp.fingerprint_texts(docs.select("text"), name="fp").collect()
    assert all(r.fp == lcp.fingerprints([r.text or ""])[0].tobytes().hex() for r in found)
