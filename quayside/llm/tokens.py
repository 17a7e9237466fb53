"""Token ids of whole texts by a public tokenizer whose file's path is a parameter."""

from __future__ import annotations

import json
import os
import re
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa

_LOADED: dict[str, TokenCounter] = {}
#: Words encoded by one call; white space parts them, and a token that ends a word ends with this.
JOINED, WORD_END = 64, "</w>"
#: Bytes of text that are cut at once; longer texts are cut at white space.  Characters of whole parts or texts to a call.
WINDOW, CALL = 4_000_000, 200_000
#: Bytes of the longest keys that are kept.
LONGEST = 64
GAP = re.compile(rb"[\t-\r ]")
#: What the tokenizer does to a text before its vocabulary counts; the cuts below follow from it.
NORMALIZED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Kinds of bytes: ASCII, and À to ɏ as letters.  A part between white space that has anything else is odd.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[[*range(9, 14), 32]] = SPACE
KIND[33:127] = MARK
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
#: First and next byte (from, to) of what is odd as well: × ÷ İ, what follows ɏ, and <| of special tokens.
ODD_PAIRS = ((0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC4, 0xB0, 0xB0), (0xC9, 0x90, 0xBF), (0x3C, 0x7C, 0x7C))
APOSTROPHE = 39
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def keys_of(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys in UTF-8 bytes that begin and end with white space, where each begins, and whether it is one word.

    The ids of a text are those of its keys.  Keys are words, digits and runs of marks, in lower
    case; a word stays with an apostrophe before it, and an odd part is a key as it is.
    """
    kind = KIND[data]
    odd = kind == ODD
    for first, low, high in ODD_PAIRS:
        at = np.flatnonzero(data[:-1] == first)
        odd[at] |= (data[at + 1] >= low) & (data[at + 1] <= high)
    space = kind == SPACE
    new = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new &= (data[:-1] != APOSTROPHE) | (kind[1:] != LETTER)
    lower, whole = LOWER[data], np.zeros(len(data), bool)
    spots = np.flatnonzero(odd)
    if len(spots):
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        begins, ends = edges[0::2], edges[1::2]
        which = np.unique(np.searchsorted(begins, spots, "right") - 1)
        step = np.zeros(len(data), np.int8)
        step[begins[which]] += 1
        step[ends[which]] -= 1
        whole = np.cumsum(step, dtype=np.int8).astype(bool)
        new &= ~(whole[1:] & whole[:-1])
        lower = np.where(whole, data, lower)
    starts = np.flatnonzero(new) + 1
    offsets = np.append(starts, len(data)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(lower)])
    kept = ~space[starts]
    starts = starts[kept]
    return runs.filter(pa.array(kept)), starts, (kind[starts] == LETTER) & ~whole[starts]


class TokenCounter:
    """ids(text) as little-endian unsigned 32-bit bytes.

    Such a tokenizer drops white space and never joins over it, nor words, digits and marks.  Arrow
    finds the distinct keys of many texts at once; ids are kept for up to `most` keys and those of one call.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.cuts = (rules["normalizer"], rules["pre_tokenizer"], rules["truncation"], rules["model"].get("end_of_word_suffix")) == (NORMALIZED, SPLIT, None, WORD_END)
        self.cuts &= all(t["content"].startswith("<|") and not t["normalized"] for t in rules["added_tokens"])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        # the same model for lower-case words, which need no other normalising and are split by spaces alone
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _single(self, texts: list[str]) -> list[bytes]:
        calls = (np.cumsum([len(t) for t in texts]) // CALL).tolist()  # what a call returns takes many times its text
        groups = (self.tokenizer.encode_batch_fast([t for _, t in group], add_special_tokens=False) for _, group in groupby(zip(calls, texts, strict=True), itemgetter(0)))
        return [np.array(e.ids, "<u4").tobytes() for group in groups for e in group]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words, many to a call; where a call doesn't give one end per word, one by one."""
        for at in range(0, len(words), 50 * JOINED):
            groups = [words[k : k + JOINED] for k in range(at, min(at + 50 * JOINED, len(words)), JOINED)]
            lines = b"\n".join(map(b" ".join, groups)).decode().lower().split("\n")
            for group, encoded in zip(groups, self.of_words.encode_batch_fast(lines, add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, "<u4")
                ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                raw = ids.tobytes()
                found = [raw[a:b] for a, b in pairwise([0, *ends])] if len(ends) == len(group) else self._single([w.decode() for w in group])
                self.known.update(zip(group, found, strict=True))

    def _window(self, texts: list[bytes]) -> list[bytes]:
        keys, starts, is_word = keys_of(np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8))
        coded = keys.dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        word = np.zeros(len(distinct), bool)
        word[at] = is_word
        word, known = word.tolist(), self.known
        if len(known) > self.most:
            known.clear()
        found = list(map(known.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([distinct[i] for i in new if word[i]])
        rest = [distinct[i] for i in new if not word[i]]
        known.update(zip(rest, self._single([k.decode() for k in rest]), strict=True))
        for i in new:
            found[i] = known[distinct[i]] if len(distinct[i]) <= LONGEST else known.pop(distinct[i])
        many = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, many = (np.cumsum(many) - many)[at], many[at]
        before = np.append(0, np.cumsum(many))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first - before[:-1], many) + np.arange(before[-1])].tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        return [ids[a:b] for a, b in pairwise([0, *(4 * before[np.searchsorted(starts, ends)]).tolist()])]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._single(texts)
        out, parts, owners, size = [b""] * len(texts), [], [], 0

        def settle() -> None:
            for owner, found in zip(owners, self._window(parts) if parts else [], strict=True):
                out[owner] += found
            parts.clear()
            owners.clear()

        for owner, text in enumerate(texts):
            data, at = text.encode(), 0
            while at < len(data):
                gap = GAP.search(data, at + WINDOW)
                part = data[at : gap.start() if gap else len(data)]
                at += len(part)
                if size + len(part) > WINDOW:
                    settle()
                    size = 0
                parts.append(part)
                owners.append(owner)
                size += len(part)
        settle()
        return out


def token_counter(path: str) -> TokenCounter:
    """One per worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = TokenCounter(path)
    return _LOADED[path]
