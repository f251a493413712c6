"""URL rules in a sorted digest array."""

from __future__ import annotations

import struct
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared

#: A part of the index has about so many bytes at most; a longer rule list has several, each a broadcast by itself.
INDEX_BYTES = 256 << 20

_OPEN: dict = {}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url: after the first :// up to /, ? or # (A-Z lower-cased), then up to ? or #."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def build_index(rules: list[tuple[str, str, str]], limit: int = INDEX_BYTES) -> list[bytes]:
    """The index of rules (verdict, host, path), in parts of ascending xxhash64 keys of the rules' strings (host and path).

    A part has the number of its rules, their keys, where each string begins, length of its host, its verdict, then the
    strings. Of equal rules the last holds.
    """
    from xxhash import xxh64_intdigest

    last = {(host, path): verdict for verdict, host, path in rules}
    entries = sorted((xxh64_intdigest((h + "\x00" + p).encode()), h, p, v) for (h, p), v in last.items())
    parts, held = [[]], 0
    for e in entries:
        size = 32 + len((e[1] + e[2]).encode())
        if parts[-1] and held + size > limit:
            parts.append([])
            held = 0
        parts[-1].append(e)
        held += size
    return [_part(p) for p in parts]


def _part(entries: list[tuple[int, str, str, str]]) -> bytes:
    import numpy as np

    strings = [(h + p).encode() for _, h, p, _ in entries]
    return b"".join(
        [
            struct.pack("<q", len(entries)),
            np.array([e[0] for e in entries], "<u8").tobytes(),
            np.cumsum([0, *map(len, strings)], dtype="<i8").tobytes(),
            np.array([len(e[1].encode()) for e in entries], "<i8").tobytes(),
            np.array([e[3] == "block" for e in entries], "<i8").tobytes(),
            b"".join(strings),
        ]
    )


class Index:
    """The arrays of a part of build_index, memory-mapped from a file without a name, which is gone with its worker."""

    def __init__(self, data: bytes):
        import numpy as np

        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = np.memmap(f, np.uint8, "r")
        n = int(self.map[:8].view("<q")[0])
        column = lambda i, kind, size: self.map[8 + 8 * n * i + 8 * (i > 1) :][: 8 * size].view(kind)
        self.keys, self.begin, self.host, self.block = column(0, "<u8", n), column(1, "<i8", n + 1), column(2, "<i8", n), column(3, "<i8", n)
        self.strings = self.map[8 + 8 * (4 * n + 1) :]
        sizes = np.diff(self.begin) - self.host
        self.path_sizes = sorted(set(sizes.tolist()))
        self.host_sizes = set(self.host.tolist())

    def __len__(self) -> int:
        return len(self.keys)

    def entry(self, i: int) -> tuple[bytes, int]:
        return self.strings[self.begin[i] : self.begin[i + 1]].tobytes(), int(self.host[i])

    def judge(self, split: list[tuple[str, str]]) -> list[tuple | None]:
        """For each (host, path) length, length of the host, rule and verdict of the longest rule that fits; None where none
        does. All probes of the list are one binary search."""
        import numpy as np
        from xxhash import xxh64_intdigest

        probes, owner = [], []
        for at, (host, path) in enumerate(split):
            raw_path = path.encode()
            suffix = host.encode()
            while suffix:
                if len(suffix) in self.host_sizes:
                    for size in self.path_sizes:
                        if size <= len(raw_path):
                            probes.append((suffix, raw_path[:size]))
                            owner.append(at)
                dot = suffix.find(b".")
                suffix = suffix[dot + 1 :] if dot >= 0 else b""
        best: list = [None] * len(split)
        if probes and len(self):
            keys = np.array([xxh64_intdigest(h + b"\x00" + p) for h, p in probes], np.uint64)
            found = np.searchsorted(self.keys, keys)
            for i in np.flatnonzero(self.keys[np.minimum(found, len(self) - 1)] == keys):
                host, path = probes[i]
                for j in range(int(found[i]), len(self)):  # rules of equal key: the stored string decides
                    if self.keys[j] != keys[i]:
                        break
                    if self.entry(j) == (host + path, len(host)):
                        rule = (host + path).decode()
                        rank = (len(rule), len(host), rule, "block" if self.block[j] else "allow")
                        best[owner[i]] = max(best[owner[i]] or rank, rank)
        return best


def judge(indexes: list[Index], split: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
    """Rule and verdict for each (host, path), None where no rule of any part fits."""
    found = [index.judge(split) for index in indexes]
    best = [max((f for f in each if f), default=(0, 0, None, None)) for each in zip(*found)]
    return [(rule, verdict) for _, _, rule, verdict in best]


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule and verdict of each row of df.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with its path;
    the longest wins, of equal length the one with the longer host. Where none fits, rule is null and verdict
    `default`: a url that isn't in the array isn't listed. A url that is null or has no :// has an empty host
    and path. Repeated rows and null ids stay; other columns aren't read; an empty table gives an empty table. The rules
    are a parameter, held by the driver; their index is broadcast in parts, whatever its size. No shuffle.
    """
    sent = [df.sparkSession.sparkContext.broadcast(part) for part in build_index(rules)]

    def make(urls: list[str | None]) -> list[pa.Array]:
        at = tuple(b._jbroadcast.id() if b._jbroadcast is not None else b._path for b in sent)
        if at not in _OPEN:
            _OPEN.clear()
            _OPEN[at] = [Index(b.value) for b in sent]
        split = [parts(u) for u in urls]
        judged = judge(_OPEN[at], split)
        return [pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([r for r, _ in judged], pa.string()), pa.array([v or default for _, v in judged], pa.string())]

    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    return shared.text_map(df, url_col, [id_col], fields, make)
