import bisect
import json
import random
import zlib

import numpy as np
from quayside.llm import queries
from quayside.llm.packing import best_fit, pack
from quayside.llm.tokens import TokenCounter
from tokenizers import Tokenizer


def test_pieces_are_the_tokenizers_ids(docs, tokenizer):
    capacity = 64
    rows = pack(docs, tokenizer, capacity).toPandas()
    plain = Tokenizer.from_file(tokenizer)
    want = []
    for d in docs.collect():
        ids = plain.encode(d.text or "", add_special_tokens=False).ids + [0]
        want += [(d.doc_id, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]
    got = [(None if d != d else int(d), s, n, c) for d, s, n, c in zip(rows.doc_id, rows.start, rows.length, rows.ids_crc32, strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= capacity and list(s.offset) == [0, *s.length.cumsum()[:-1]]


def test_empty_table(no_docs, tokenizer):
    assert pack(no_docs, tokenizer).count() == 0


def test_best_fit_places_every_rank_once_and_packs_tightly():
    r = random.Random(5)
    for capacity in (10, 64, 2048):
        lengths = sorted((min(capacity, int(r.expovariate(4 / capacity)) + 1) for _ in range(3000)), reverse=True)
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan, sequences = best_fit(counts, capacity)
        filled: dict[int, list[tuple[int, int]]] = {}
        for rank, n in enumerate(lengths):
            k = np.searchsorted(plan[:, 0], rank, "right") - 1
            filled.setdefault(int(plan[k, 1] + rank - plan[k, 0]), []).append((int(plan[k, 2]), n))
        assert len(filled) == sequences
        for parts in filled.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        assert sequences <= 1.05 * sum(lengths) / capacity + 1
    assert best_fit({})[1] == 0


def plain_best_fit(lengths, capacity):
    """Longest first, each into the smallest gap that holds it: how many sequences that takes."""
    gaps, sequences = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        if at == len(gaps):
            sequences += 1
            gap = capacity
        else:
            gap = gaps.pop(at)
        if gap > n:
            bisect.insort(gaps, gap - n)
    return sequences


def test_as_few_sequences_as_plain_best_fit():
    r = random.Random(8)
    for _ in range(150):
        capacity = r.choice([7, 20, 100, 2048])
        lengths = [r.randint(1, capacity) if r.random() < 0.5 else r.randint(1, max(1, capacity // 3)) for _ in range(r.randint(0, 400))]
        assert best_fit({n: lengths.count(n) for n in set(lengths)}, capacity)[1] == plain_best_fit(lengths, capacity)


def test_query_against_plain_best_fit(spark):
    rows = queries.QUERIES["op2_best_fit_packing"](spark, "/root/testdata/sf0.001").toPandas()
    assert rows.sequence_id.nunique() == plain_best_fit(rows.length.tolist(), 2048)


def test_kept_ids_equal_the_tokenizers(tokenizer):
    r = random.Random(3)
    bits = ["'s", "'", "Ab", "é", "İ", "ß", "ΣΑΣ", "1", "<|endoftext|>", "<|", ".", "!!", " ", " ", "́", "한국", "ª", "\x1c", "don't", "we're", "😀"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 9))) for _ in range(2000)]
    counter = TokenCounter(tokenizer, most=300)
    got = [x for k in range(0, 2000, 50) for x in counter.ids(texts[k : k + 50])]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_are_encoded_once_whatever_stands_around_them(tokenizer):
    words = [a + b for a in ("alpha", "beta", "gärten", "delta") for b in ("", "tor", "ment", "ville")]
    texts = [f"{a}-{b.title()}. ({b}/{a})" for a in words for b in words]
    counter = TokenCounter(tokenizer)
    assert counter.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(counter.known) <= len(words) + 10  # the words and runs of marks, not their pairs


def test_cut_texts_equal_the_tokenizers(tokenizer, monkeypatch):
    r = random.Random(4)
    bits = ["H\u0331", "=\u0338", "e\u0301", "\u0130", "I\u0307", "\u023a", "\u024f", "\u0250", "\u00d7", "\u00f7", "\u1e9e", "\u212a", "\u01c5", "\x00", "\x1c", "\x85", "\u00a0", "\u2026", "\u00e9t\u00e9", "\u00c9T\u00c9"]
    bits += ["'s", "'", "'LL", "a-b", "12", "<", "|", ">", "<|startoftext|>", "...", " ", " ", "\n", "word", "Word"]
    counter = TokenCounter(tokenizer, most=200)
    for window in (1, 30, 4_000_000):
        monkeypatch.setattr("quayside.llm.tokens.WINDOW", window)
        texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(2000)] + [" ".join(r.choices(bits, k=300))]
        assert counter.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_tokenizer_with_other_rules_encodes_whole_texts(tokenizer, tmp_path):
    rules = json.loads(open(tokenizer, encoding="utf-8").read())
    rules["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules))
    texts = ["The Cat", "the-cat", ""]
    counter = TokenCounter(str(path))
    assert counter.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
