import re
from collections import Counter

import quayside.llm.decontaminate as module
from quayside.llm.decontaminate import decontaminated, find_contamination, window_fingerprints, word_hashes

from .conftest import SCHEMA, prose


def items(spark):
    rows = [(i, prose(100 + i, 20 + i)) for i in range(12)] + [(50, "one two three"), (51, None), (52, ""), (None, "x y"), (53, prose(100, 20))]
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(text, bench):
    def runs(words):
        return [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]

    words, out = re.findall(r"\w+", (text or "").lower()), set()
    for item_id, item in bench:
        want = re.findall(r"\w+", (item or "").lower())
        if item_id is None or not want:
            continue
        target = Counter(runs(want))
        for k in range(len(words) - len(want) + 1):
            now = Counter(runs(words[k : k + len(want)]))
            both = sum((now & target).values())
            if both >= 0.8 * (sum(now.values()) + sum(target.values()) - both):
                out.add(item_id)
    return sorted(out)


def test_against_brute_force(spark, docs):
    bench = items(spark)
    known = [tuple(r) for r in bench.collect()]
    rows = []
    for i in range(12):
        item = known[i][1].split()
        rows.append((i, " ".join([prose(i, 40), *item, prose(i + 50, 30)])))
        rows.append((100 + i, " ".join([prose(i, 7), *item[:-1], "Changed!", prose(i + 70, 90)])))
        rows.append((200 + i, " ".join([prose(i, 20), *item[: len(item) // 2], prose(i + 90, 20)])))
    rows += [(300, "and ONE, two - three."), (301, None), (302, "")]
    table = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], SCHEMA).unionByName(docs)
    got = find_contamination(table, bench).collect()
    texts = dict(rows)
    assert len(got) == table.count()
    for r in got:
        if r.doc_id in texts and r.doc_id >= 14:
            assert r.item_ids == brute(texts[r.doc_id], known)
            assert r.contaminated == bool(r.item_ids)
    assert {r.doc_id for r in got if r.contaminated} >= set(range(12)) | {300}


def test_passes_of_the_benchmark(spark, monkeypatch):
    bench = items(spark)
    docs = spark.createDataFrame([(1, prose(101, 21) + " and " + prose(105, 25), *[None] * 7)], SCHEMA)
    want = find_contamination(docs, bench).first().item_ids
    monkeypatch.setattr(module, "PASS_ITEMS", 3)
    assert sorted(find_contamination(docs, bench).first().item_ids) == sorted(want) == [1, 5]
    monkeypatch.setattr(module, "PASSES", 1)  # a stage and a written table per pass
    assert sorted(find_contamination(docs, bench).first().item_ids) == [1, 5]
    assert decontaminated(docs, bench).count() == 0


def test_columns_of_any_name_stay(spark):
    odd = spark.createDataFrame([(1, prose(1, 50), "a", "b")], "doc_id long, text string, quayside_hits string, hits string")
    assert decontaminated(odd, items(spark)).collect() == odd.collect()


def test_stage_and_empty_tables(spark, docs, no_docs):
    bench = items(spark)
    assert decontaminated(docs, bench).columns == docs.columns
    assert decontaminated(docs, bench).count() == docs.count()
    assert find_contamination(no_docs, bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_window_fingerprints_equal_those_of_the_windows():
    hashes = word_hashes(prose(3, 80))
    whole = window_fingerprints(hashes, 30)
    assert [int(x) for x in whole] == [int(window_fingerprints(hashes[k : k + 30], 30)[0]) for k in range(51)]


def test_texts_shorter_than_an_item(spark):
    item = prose(77, 44).split()  # 40 shingles
    bench = spark.createDataFrame([(1, " ".join(item)), (2, prose(78, 30))], "item_id long, text string")
    rows, want = [], set()
    for cut in range(1, 20):
        for i, words in enumerate((item[:-cut], item[cut:], item[cut // 2 : len(item) - (cut + 1) // 2])):
            rows.append((3 * cut + i, " ".join(words)))
            left = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
            if len(left) >= 0.8 * 40:  # all of them are the item's
                want.add(3 * cut + i)
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], SCHEMA)
    got = find_contamination(docs, bench).collect()
    assert {r.doc_id for r in got if r.item_ids == [1]} == {r.doc_id for r in got if r.contaminated} == want and len(want) == 24
    assert decontaminated(docs, bench).count() == len(rows) - 24
