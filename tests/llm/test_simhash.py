import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from quayside.llm import simhash as module
from quayside.llm.shared import shared_root
from quayside.llm.simhash import bit_groups, fingerprint, fingerprint_links, near_duplicates, run_links, thresholds, without_near_copies

from .conftest import SCHEMA, prose


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in ["", "One", "one two", "A b C d e f", prose(1), prose(2, 5000), "é É 😀 x"]:
        assert fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_components_of_a_corpus(spark, docs):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    fps = [brute_fingerprint(r.text) if "\x00" not in (r.text or "") else fingerprint(r.text) % (1 << 64) for r in rows]
    roots = components(fps, 3)
    want = {(r.doc_id, f"{f:016x}", min(x.doc_id for x, k in zip(rows, roots, strict=True) if k == root)) for r, f, root in zip(rows, fps, roots, strict=True)}
    got = near_duplicates(docs.filter("doc_id IS NOT NULL")).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert near_duplicates(docs).count() == docs.count()


def test_links_connect_what_brute_force_connects(spark):
    r = random.Random(7)
    fps = [r.getrandbits(64) for _ in range(150)]
    for f in fps[:40]:
        for _ in range(8):  # clusters of near fingerprints, with chains
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            fps.append(f)
    base = r.getrandbits(64)
    fps += [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # one large bucket
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius, parts in ((3, (3,)), (5, (3, 4)), (1, (2,))):
        links = fingerprint_links(nodes, radius, parts).collect()
        at = {f: i for i, f in enumerate(signed)}
        assert all(((x.a ^ x.b) % (1 << 64)).bit_count() <= radius for x in links)
        parent = list(range(len(signed)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x in links:
            a, b = find(at[x.a]), find(at[x.b])
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(signed))] == components([f % (1 << 64) for f in signed], radius)


def test_thresholds_are_unequal_and_sum_up():
    both = np.full((64, 64), 25.0)
    np.fill_diagonal(both, 50.0)
    groups = bit_groups(100, both, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    for radius in (1, 3, 7):
        allotted, _ = thresholds(100, both, groups, radius)
        assert sum(t + 1 for t in allotted) == radius + 1
    assert len(set(thresholds(100, both, groups, 3)[0])) > 1


def test_long_runs_give_one_link_per_member():
    fps = np.array([1 << a | 1 << b for a in range(60) for b in range(a)], np.uint64)
    a, b = run_links(np.zeros(len(fps), np.int64), fps, 4)
    assert len(a) == len(fps) - 1


def test_near_copies_of_texts(spark, no_docs):
    words = prose(1, 300).split()
    near = [*words[:150], "changed", *words[151:]]
    far = [w if i % 9 else "other" for i, w in enumerate(words)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(far)), (6, prose(2, 300)), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], SCHEMA)
    got = without_near_copies(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [3, 4, 6, 7]
    assert without_near_copies(no_docs).count() == 0
    assert near_duplicates(no_docs).count() == 0


def test_awkward_rows_stay(docs):
    assert without_near_copies(docs).count() > 0


def test_star_of_variants_is_one_group(spark):
    r, base = random.Random(3), prose(11, 204).split()
    rows = [(1000, " ".join(base))]
    for i in range(300):  # about 0.85 like the base, under 0.8 like one another
        words = list(base)
        for k in range(3):
            words[r.randint(70 * k, 70 * k + 50)] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], SCHEMA).repartition(4)
    assert [x.doc_id for x in without_near_copies(docs).collect()] == [0]
    assert without_near_copies(docs.filter("doc_id < 40")).count() > 1


def test_hot_keys_lose_no_link(spark, monkeypatch):
    import quayside.llm.simhash as module

    r, rows = random.Random(5), []
    passage = prose(40, 60).split()
    for i in range(60):  # a passage in all texts, and chains of ever changed copies
        words = passage + prose(200 + i // 6, 90).split()
        for _ in range(i % 6 * 2):
            words[r.randrange(len(words))] = f"c{i}"
        rows.append((i, " ".join(words)))
    rows += [(60 + i, rows[i][1]) for i in range(0, 60, 9)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], SCHEMA).repartition(3)
    want = sorted({find(i) for i in range(len(rows))})
    for pairwise, pivots, block, hot in ((64, 4, 512, 200_000), (2, 1, 3, 200_000), (1, 0, 2, 200_000), (64, 4, 8, 3), (2, 2, 3, 1)):
        monkeypatch.setattr(module, "HOT_RUN", hot)
        monkeypatch.setattr(module, "PAIRWISE", pairwise)
        monkeypatch.setattr(module, "PIVOTS", pivots)
        monkeypatch.setattr(module, "BLOCK", block)
        assert sorted(x.doc_id for x in without_near_copies(docs).collect()) == want


def test_copies_with_an_added_passage_go(spark):
    rows, want = [], []
    for i, (n, added) in enumerate([(104, 24), (204, 49), (404, 99), (104, 12), (404, 40), (14, 1), (14, 2)]):
        for k in range(6):  # appended, put in front, and put inside
            words, more = prose(1000 + 10 * i + k, n).split(), prose(5000 + 10 * i + k, added).split()
            at = [n, 0, n // 2][k % 3]
            rows += [(100 * i + 2 * k, " ".join(words)), (100 * i + 2 * k + 1, " ".join(words[:at] + more + words[at:]))]
            sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows[-2:])]
            want += [rows[-2][0]] if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) else [rows[-2][0], rows[-1][0]]
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], SCHEMA)
    assert len(want) < len(rows) * 0.7
    assert sorted(x.doc_id for x in without_near_copies(docs).collect()) == sorted(want)


@pytest.mark.parametrize("most", [4, 20])
def test_long_runs_of_fingerprints_are_dealt_into_blocks(spark, most):
    """Fingerprints that all share their upper half: the components are those of all pairs within the radius."""
    r = random.Random(most)
    prints = sorted({(0xABCD1234 << 32 | sum(1 << b for b in r.sample(range(32), 9))) - (1 << 64) for _ in range(300)})
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 5:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {x.node: x.root for x in module.component_roots(module.fingerprint_links(nodes, 5, most=most)).collect()}
    assert {p: roots.get(p, p) for p in prints} == {p: find(p) for p in prints}


@pytest.mark.parametrize("pairwise", [64, 1])
def test_tables_go_when_no_step_reads_them(spark, docs, monkeypatch, pairwise):
    def there():
        return {p.name for p in Path(shared_root(spark).removeprefix("file://")).iterdir()}

    at, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (write(df, name), at.append({n.rsplit("-", 1)[0] for n in there() - before}))[0])
    monkeypatch.setattr(module, "PAIRWISE", pairwise)
    before = there()
    got = without_near_copies(docs)
    read = {f.split("/")[-2] for f in got.inputFiles()}
    assert there() - before <= read and len(read) == 2  # the texts and the groups
    assert not [names for names in at if "near-prefixes" in names and "near-candidates" in names]
    assert not [names for names in at if "near-distinct" in names and "near-pairs" in names]
    assert got.count() == got.count() > 0
