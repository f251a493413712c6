"""Vocabulary files, read by the driver and broadcast: their path need not exist on the executors."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Vocabulary files have a few MB; a larger one is refused, not broadcast.
VOCABULARY_BYTES = 64 << 20

_BUILT: dict = {}
_ASKED: set = set()


def load(spark: SparkSession, path: str) -> Broadcast:
    if (size := os.path.getsize(path)) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary has at most {VOCABULARY_BYTES}")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def once(key: str, data: Broadcast, build: Callable):
    """build(bytes of the file), once for each Python worker and broadcast."""
    at = (key, data._jbroadcast.id() if data._jbroadcast is not None else data._path)
    if at not in _BUILT:
        _BUILT.clear()  # a worker serves one vocabulary at a time; the former one's memos go
        _BUILT[at] = build(data.value)
    _ASKED.add(at)
    return _BUILT[at]


def settle() -> None:
    """At the end of a task: what it didn't ask for goes, so that a worker holds no vocabulary of an earlier stage."""
    for at in _BUILT.keys() - _ASKED:
        del _BUILT[at]
    _ASKED.clear()


def ranks(data: bytes) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: a line for each, base64 and number."""
    out = {}
    for line in data.splitlines():
        if line.strip():
            piece, rank = line.split()
            out[base64.b64decode(piece)] = int(rank)
    return out
