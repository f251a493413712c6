"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, vocabulary
from .pretokens import BYTE_CHARS, Memo, explicit


#: Merging in Python is dear, so words are kept in larger memos (twice so many bytes) than elsewhere.
MEMO_BYTES = 48 << 20


class PairCounter:
    """Counts what a word merges to: the initial symbols less the merges made.

    The symbols of a word are a doubly linked list, its mergeable neighbours a heap of (rank, position). The
    pair of lowest rank merges first, the leftmost of equals; entries whose pair is gone are skipped. Only the
    number of merges is kept.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.start = [vocab[c] for c in BYTE_CHARS]
        self.end = [vocab[c + suffix] for c in BYTE_CHARS]
        self.width = len(vocab) + 1
        self.pairs = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left] * self.width + vocab[right]] = (rank, vocab[left + right])

    def __call__(self, word: bytes) -> int:
        symbols = [self.start[b] for b in word]
        symbols[-1] = self.end[word[-1]]
        n = left = len(symbols)
        width, pairs = self.width, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (found := pairs.get(symbols[i] * width + symbols[i + 1])) is not None:
                heap.append((found[0], i))
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = pairs.get(symbols[i] * width + symbols[j])
            if found is None or found[0] != rank:
                continue
            symbols[i], symbols[j] = found[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := pairs.get(symbols[i] * width + symbols[k])) is not None:
                    heappush(heap, (found[0], i))
            if (h := before[i]) >= 0 and (found := pairs.get(symbols[h] * width + symbols[i])) is not None:
                heappush(heap, (found[0], h))
        return left


class TextCounter:
    """Tokens of whole texts under a tokenizer file with NFC, lower case, white space dropped and word ends."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a BPE vocabulary with NFC, white space and lower case normalisation is needed")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(explicit(split)).findall
        self.piece = Memo(PairCounter(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]), MEMO_BYTES)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.marks = special

    def _word(self, word: str) -> int:
        word = unicodedata.normalize("NFC", word)
        # Lower case letter by letter: str.lower() has a rule for a final sigma, the library has none.
        word = word.lower() if "Σ" not in word else "".join(map(str.lower, word))
        return sum(self.piece[p.encode()] for p in self.find(word))

    def _whole(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._word, parts))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; texts: strings without nulls."""
        # str.split() also parts at U+001C to U+001F, which are symbols to the library.
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False).copy()
        for m in self.marks:
            odd |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        at = np.flatnonzero(odd)
        if len(at):
            out[at] = [self._whole(t) for t in texts.take(pa.array(at)).to_pylist()]
            texts = texts.filter(pa.array(~odd))
        # White space never reaches a token and composes with nothing: words count by themselves, each distinct one once.
        cut = pc.utf8_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        counts = np.fromiter(map(self._word, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        ends = cut.offsets.to_numpy()
        sums = np.concatenate([[0], np.cumsum(counts[words.indices.to_numpy()])])
        out[~odd] = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
        return out


def token_counts(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, n_bytes (UTF-8) and n_tokens of the whole text.

    vocab_path: a tokenizers file, read by the driver. A null text counts as empty (0 and 0); repeated rows and
    null ids stay as rows; other columns of df aren't read. An empty table gives an empty table. No shuffle.
    """
    data: Broadcast = vocabulary.load(df.sparkSession, vocab_path)

    def make(texts: pa.Array) -> list[pa.Array]:
        count = vocabulary.once("word counts", data, TextCounter)
        return [pc.binary_length(texts).cast(pa.int64()), pa.array(count(texts))]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return shared.text_map(df, text_col, [id_col], fields, make, arrow_texts=True)


def over_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    """counts with `over_limit`: more than `limit` tokens; exactly so many aren't over. Empty texts have none."""
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
