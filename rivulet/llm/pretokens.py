"""Pre-tokens of byte-level vocabularies: texts are cut in bulk, and each distinct piece is encoded once.

Byte-level BPE never merges across pre-tokens, so what a pre-token encodes to can be kept. Almost every text can be
cut at single spaces and newlines, far faster than by a regular expression; the rule below says when that gives
the same pre-tokens. Other texts take the pattern itself. Words of a slice of texts are put into a dictionary by
Arrow, its distinct words are encoded, and their ids are gathered, so that Python handles distinct words alone.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Unicode's White_Space, what \s means to the libraries (Python's \s adds U+001C to U+001F).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
RARE_WIDE = WHITE[6:]

#: Bytes that a worker's memo holds, twice: at the bound the older half goes. Longer keys aren't kept.
MEMO_BYTES, MEMO_KEY = 8 << 20, 64

#: Bytes that an entry takes in a dictionary, beside its key and value.
ENTRY = 100
#: Marks that end words; a run of them after letters is a pre-token of its own. The apostrophe isn't one: it may
#: begin a contraction.
MARKS = ".,;:!?%&*#$|)]}\"»…-"


def explicit(pattern: str) -> str:
    r"""The pattern with \s and \S as the white space above, outside and inside of classes."""
    inner = "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else c for c in WHITE)
    out, i, in_class = [], 0, False
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(inner if in_class else f"[{inner}]")
        elif pair == r"\S":
            out.append(f"[^{inner}]")
        elif pair[0] == "\\":
            out.append(pair)
        else:
            in_class = pair[0] == "[" or in_class and pair[0] != "]"
            out.append(pair[0])
            i -= 1
        i += 2
    return "".join(out)


class Memo(dict):
    """make(key), kept for two generations of about `bound` bytes each. Values are bytes or small numbers."""

    def __init__(self, make: Callable, bound: int = MEMO_BYTES):
        self.make, self.bound, self.old, self.held = make, bound, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMO_KEY:
                return value
        if self.held >= self.bound:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += sys.getsizeof(key) + sys.getsizeof(value) + ENTRY
        self[key] = value
        return value


#: What texts have for which cutting at each space and newline doesn't give whole pre-tokens: runs of
#: white space but for a pair of newlines before a word, and white space other than space and newline.
ODD = r"  |\n | \n|\n\n\n|\n\n\z|[\t\x0b\x0c\r" + RARE_WIDE + "]"


class Encoder:
    """Ids of texts: those of their pre-tokens, one after the other. `encode` gives a list of ids for each of its pre-tokens."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], pa.ListArray]):
        self.find = regex.compile(explicit(pattern)).findall
        self.encode = encode

    def _coded(self, pieces: list[list[str]]) -> pa.ListArray:
        """Ids of each list of pre-tokens; each distinct one is encoded once."""
        at: dict[str, int] = {}
        order = [at.setdefault(p, len(at)) for found in pieces for p in found]
        found = self.encode(list(at)).take(pa.array(order, pa.int64()))
        ends = np.cumsum([0, *map(len, pieces)], dtype=np.int64)
        return pa.ListArray.from_arrays(found.offsets.take(pa.array(ends)), found.flatten())

    def _part(self, part: str) -> list[str]:
        """Pre-tokens of a part of a text between two cuts, which a space or a newline precedes."""
        return ["\n", *self.find(part[1:])] if part[:1] == "\n" else self.find(" " + part)

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids (int32) for each text; texts: strings without nulls."""
        odd = pc.match_substring_regex(texts, ODD)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return self._plain(texts)
        coded = self._coded([*map(self.find, texts.take(pa.array(at)).to_pylist())])
        if len(at) == len(texts):
            return coded
        rest = self._plain(texts.filter(pc.invert(odd)))
        return merged(len(texts), at, coded, rest)

    def _plain(self, texts: pa.Array) -> pa.ListArray:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends, words = cut.offsets.to_numpy().astype(np.int64), cut.values
        ends, words = ends - ends[0], words.slice(int(ends[0]), int(ends[-1] - ends[0]))
        coded = words.dictionary_encode()
        # The first part of a text has no space before it.
        heads = words.take(pa.array(ends[:-1])).dictionary_encode()
        table = pa.concat_arrays([self._parts(coded.dictionary), self._coded([*map(self.find, heads.dictionary.to_pylist())])])
        at = coded.indices.to_numpy().copy()
        at[ends[:-1]] = heads.indices.to_numpy() + len(coded.dictionary)
        sizes = np.diff(table.offsets.to_numpy())
        last = np.concatenate([[0], np.cumsum(sizes[at], dtype=np.int64)])[ends]
        return pa.ListArray.from_arrays(pa.array(last.astype(np.int32)), table.take(pa.array(at)).flatten())

    def _parts(self, parts: pa.Array) -> pa.ListArray:
        """Ids of distinct parts. Letters and the marks after them are two pre-tokens; each distinct one is encoded once."""
        stems = pc.utf8_rtrim(parts, MARKS)
        letters = pc.utf8_is_alpha(stems)
        at = np.flatnonzero(~letters.to_numpy(zero_copy_only=False))
        odd = self._coded([*map(self._part, parts.take(pa.array(at)).to_pylist())])
        parts, stems = parts.filter(letters), stems.filter(letters)
        words, marks = stems.dictionary_encode(), _suffixes(parts, stems).dictionary_encode()
        table = pa.concat_arrays([self.encode([" " + w for w in words.dictionary.to_pylist()]), self._coded([[m] if m else [] for m in marks.dictionary.to_pylist()])])
        pairs = np.empty(2 * len(parts), np.int64)
        pairs[0::2], pairs[1::2] = words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)
        found = table.take(pa.array(pairs))
        plain = pa.ListArray.from_arrays(found.offsets.take(pa.array(np.arange(0, 2 * len(parts) + 1, 2))), found.values)
        return merged(len(odd) + len(plain), at, odd, plain) if len(odd) else plain


def _suffixes(strings: pa.Array, stems: pa.Array) -> pa.Array:
    """What each string has after its stem."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :][: len(strings) + 1]
    both = np.empty(2 * len(strings) + 1, np.int32)
    both[0::2] = ends
    both[1::2] = ends[:-1] + pc.binary_length(stems).to_numpy()
    cut = pa.Array.from_buffers(pa.string(), 2 * len(strings), [None, pa.py_buffer(both.tobytes()), strings.buffers()[2]])
    return cut.take(pa.array(np.arange(1, 2 * len(strings), 2)))


def flat(lists: list[list[int]]) -> pa.ListArray:
    """Lists of int32 from lists of numbers."""
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))))


def listed(codes: list[bytes]) -> pa.ListArray:
    """Lists of int32 from their bytes."""
    ends = np.cumsum([0, *map(len, codes)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(codes), "<i4")))


def merged(n: int, at: np.ndarray, these: pa.ListArray, others: pa.ListArray) -> pa.ListArray:
    """n lists: `these` at the places `at`, the others in turn."""
    order = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[at] = False
    order[at] = np.arange(len(at))
    order[rest] = len(at) + np.arange(n - len(at))
    return pa.concat_arrays([these, others]).take(pa.array(order))


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the other bytes, in order, for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


BYTE_CHARS = byte_chars()
_TABLE = dict(enumerate(BYTE_CHARS))


def byte_mapped(piece: str) -> str:
    if piece.isascii() and piece[1:].isalnum():
        return "Ġ" + piece[1:] if piece[0] == " " else piece.translate(_TABLE)
    return piece.encode().decode("latin-1").translate(_TABLE)
