"""Removal of long word sequences that an earlier document has, by a compacted de Bruijn graph of word k-mers.

A k-mer (a window of 50 words) is an edge of the graph. Edges aren't shuffled one by one: consecutive windows of
a document that have the same minimizer (the least hash of their inner 12-mers, so a function of the window's own
words) form one path, a row with the minimizer, the number of windows and digests of its words. Then, in Spark:

1. Minimizers of one document alone hold no repeated edge; their paths go.
2. Paths with the same digest are one nonbranching path. Its source is its place in its smallest document; everywhere
   else the whole path is repeated.
3. A minimizer with different paths is a branch: there the paths of the sources, one for each digest, are split
   into single edges, which are joined edge by edge.

Both give spans (document, start, end) and their source coordinates (document, start). Spans that go on in document and
source alike are one. Each is then verified: the words at the source coordinates, read from the source's text, are
compared with the document's own, and only runs of a window or more that are equal count. Copies and shared passages cost a row for about 20
words each, and only the ends of passages cost a row a window. All group steps have partial aggregates, and
joins are of rows that Spark can split by key, so a passage that a third of all documents hold is no hot task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Words of a window, and of the inner k-mers whose least hash is its minimizer.
WINDOW = 50
INNER = 12

#: Windows that are handled at once; longer texts are cut, which splits paths but loses no window.
_BLOCK = 1 << 19

#: Words of a source that are handed out together for the comparison.
GRID = 128

#: Odd bases of the two digests.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_POWERS: dict = {}


def _powers(base: int, n: int):
    """Powers of base and of its inverse modulo 2^64."""
    import numpy as np

    if base not in _POWERS or len(_POWERS[base][0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b % (1 << 64), np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[base]


class Digests:
    """Digests of any run of the words given, from prefix sums of a polynomial over their hashes modulo 2^64."""

    def __init__(self, hashes, base: int):
        import numpy as np

        power, self.inverse = _powers(base, len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)])

    def __call__(self, start, end):
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]):
    """Two independent 64-bit hashes of each word."""
    import numpy as np
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _row_key(text: str) -> int:
    """Parts rows that share an id: crc32 of the text, as Spark's crc32 has it."""
    return zlib.crc32(text.encode())


def _least(values, width: int):
    """The least of each `width` consecutive values."""
    import numpy as np

    step = 1
    while 2 * step <= width:
        values = np.minimum(values[: len(values) - step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def _paths(words: list[bytes], counts: list[int], window: int, inner: int):
    """Paths of documents whose words are given one after the other: document, start, windows, minimizer, digest, check."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    empty = np.zeros(0, np.int64)
    if len(words) < window:
        return (empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(np.uint64))
    one, two = _hashes(words)
    check, digest = Digests(one, _BASES[0]), Digests(two, _BASES[1])
    at = np.arange(len(words) - inner + 1)
    minimizer = _least(_mix(check(at, at + inner)), window - inner + 1)
    document = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = np.arange(len(words) - window + 1)
    owner = document[: len(starts)]
    whole = owner == document[window - 1 :]
    new = np.ones(len(starts), bool)
    new[1:] = (minimizer[1:] != minimizer[:-1]) | (owner[1:] != owner[:-1])
    begin = starts[new & whole]
    # A path ends where the next one begins or where windows stop being of one document.
    stops = np.flatnonzero(new | ~whole)
    end = np.append(stops, len(starts))[np.searchsorted(stops, begin, side="right")]
    n = end - begin
    last = begin + n + window - 1
    salt = n.astype(np.uint64) * np.uint64(_BASES[0])
    return owner[begin], begin - first[owner[begin]], n, minimizer[begin], _mix(digest(begin, last) ^ salt), check(begin, last)


def _blocks(texts: list[str], window: int) -> Iterator[tuple[list[bytes], list[int], list[tuple[int, int]]]]:
    """Words, their counts and (text, offset) of pieces of texts; a long text's pieces overlap by a window less one word."""
    words, counts, at = [], [], []
    for i, text in enumerate(texts):
        found = text.encode().split()
        for offset in range(0, max(1, len(found) - window + 1), _BLOCK):
            piece = found[offset : offset + _BLOCK + window - 1] if len(found) > _BLOCK else found
            if len(words) + len(piece) > 2 * _BLOCK:
                yield words, counts, at
                words, counts, at = [], [], []
            words += piece
            counts.append(len(piece))
            at.append((i, offset))
    yield words, counts, at


def _signed(values):
    import numpy as np

    return pa.array(values.astype(np.uint64).view(np.int64))


def _fields(text: str) -> list[T.StructField]:
    return list(T._parse_datatype_string(text).fields)


def paths(df: DataFrame, window: int, inner: int) -> DataFrame:
    """Rows (doc_id, row, start, n, minimizer, digest, check) of df's columns doc_id and text."""
    schema = T.StructType([df.schema["doc_id"], *_fields("row long, start int, n int, minimizer long, digest long, check long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in shared.slices(batch, 1):
                ids, texts = part.column(0), part.column(1).to_pylist()
                rows = np.asarray([_row_key(t) for t in texts], np.int64)
                for words, counts, at in _blocks(texts, window):
                    owner, start, n, minimizer, digest, check = _paths(words, counts, window, inner)
                    which = np.asarray([i for i, _ in at], np.int64)[owner] if len(owner) else owner
                    offset = np.asarray([o for _, o in at], np.int64)[owner] if len(owner) else owner
                    columns = [ids.take(pa.array(which)), pa.array(rows[which]), pa.array((start + offset).astype(np.int32)), pa.array(n.astype(np.int32)), _signed(minimizer), _signed(digest), _signed(check)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "start", "n", "minimizer", "digest", "check"])

    return shared.map_arrow(df, run, schema)


def _edges(df: DataFrame, window: int) -> DataFrame:
    """Single windows (doc_id, row, start, edge, check) of the paths that df lists beside each text."""
    schema = T.StructType([df.schema["doc_id"], *_fields("row long, start int, edge long, check long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                one, two = _hashes(batch.column(2)[i].as_py().encode().split())
                listed = batch.column(3)[i].as_py()
                start = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in listed]))
                if not len(start):
                    continue
                edge, check = Digests(two, _BASES[1])(start, start + window), Digests(one, _BASES[0])(start, start + window)
                at = pa.array(np.full(len(start), i))
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), _signed(edge), _signed(check)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "start", "edge", "check"])

    return shared.map_arrow(df, run, schema)


def repeated_spans(df: DataFrame, scratch: shared.Scratch, window: int = WINDOW, inner: int = INNER) -> DataFrame:
    """(doc_id, row, start, end, source, source_row, source_start): words start to end of a document's row are windows that
    `source`, a document of smaller id, has from word source_start on, by their digests. df: doc_id and text (string),
    not null. Spans may overlap."""
    found = scratch.table(paths(df, window, inner))
    joint = found.groupBy("minimizer").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    # Aggregates are written before rows join them: Spark splits a hot key of a join of two plain shuffles only.
    joint = scratch.table(joint.where("lo < hi").select("minimizer", (F.col("d0") < F.col("d1")).alias("branches")))
    met = scratch.table(found.join(joint, "minimizer"))
    place = F.min(F.struct("doc_id", "row", "start")).alias("at")
    at = [F.col("at.doc_id").alias("source"), F.col("at.row").alias("source_row"), F.col("at.start").alias("source_start")]
    sources = met.groupBy("minimizer", "digest").agg(place, F.min("check").alias("c0"), F.max("check").alias("c1"))
    sources = scratch.table(sources.select("minimizer", "digest", *at, (F.col("c0") == F.col("c1")).alias("same")))
    judged = scratch.table(met.join(sources, ["minimizer", "digest"]))
    coordinates = ["source", "source_row", "source_start"]
    whole = judged.where("doc_id > source and same").select("doc_id", "row", "start", (F.col("start") + F.col("n") + F.lit(window - 1)).alias("end"), *coordinates)
    split = judged.where("not same or (branches and doc_id = source)")
    listed = scratch.table(split.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("paths")))
    edges = scratch.table(_edges(_beside(df, listed, "paths"), window))
    heads = edges.groupBy("edge", "check").agg(place, F.max("doc_id").alias("last")).where("at.doc_id < last").select("edge", "check", *at)
    heads = scratch.table(heads)
    single = edges.join(heads, ["edge", "check"]).where("doc_id > source").select("doc_id", "row", "start", (F.col("start") + F.lit(window)).alias("end"), *coordinates)
    return scratch.table(whole).union(scratch.table(single))


def _beside(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """(doc_id, row, text, column) of the rows of df that listed (doc_id, row, column) names."""
    texts = df.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("row"), "text")
    return texts.join(listed, ["doc_id", "row"]).select("doc_id", "row", "text", column)


def _pieces(spans: DataFrame) -> DataFrame:
    """(doc_id, row, span, start, n, source, source_row, block, offset): spans, those that go on alike in document and source
    made one, cut at the source's grid. Words from start on, n of them, are at `offset` of the source's block."""
    kinds = {f.name: f for f in spans.schema.fields}
    schema = T.StructType([kinds["doc_id"], *_fields("row long, span int, start int, n int"), kinds["source"], *_fields("source_row long, block int, offset int")])
    # Of as many spans as the document has paths and split windows at most.
    listed = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end", "source", "source_row", "source_start")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            start, end, row, source_start = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "end", "source_row", "source_start"))
            source = flat.field("source").dictionary_encode()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            keys = np.stack([owner, source.indices.to_numpy().astype(np.int64), row, source_start - start])
            order = np.lexsort([start, *keys[::-1]])
            keys, start, end = keys[:, order], start[order], end[order]
            new = np.ones(len(start), bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            group = np.cumsum(new) << 33
            reach = np.maximum.accumulate(end + group) - group
            new[1:] |= start[1:] > reach[:-1]
            first = np.flatnonzero(new)
            if not len(first):
                continue
            at, begin, stop = order[first], start[first], np.maximum.reduceat(end, first)
            low = begin + keys[3][first]
            count = (low + stop - begin - 1) // GRID - low // GRID + 1
            span = np.repeat(np.arange(len(first)), count)
            block = (low // GRID)[span] + np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
            left, right = np.maximum(low[span], block * GRID), np.minimum((low + stop - begin)[span], (block + 1) * GRID)
            who, what = pa.array(owner[at][span]), pa.array(at[span])
            ints = [pa.array(x.astype(np.int32)) for x in (span, begin[span] + left - low[span], right - left)]
            columns = [batch.column(0).take(who), batch.column(1).take(who), *ints, flat.field("source").take(what), pa.array(row[at][span]), pa.array(block.astype(np.int32)), pa.array((left - block * GRID).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return shared.map_arrow(listed, run, schema)


def _source_blocks(beside: DataFrame) -> DataFrame:
    """(source, source_row, block, words): the listed blocks of each text, their words joined by one space."""
    schema = T.StructType([T.StructField("source", beside.schema["doc_id"].dataType), *_fields("source_row long, block int, words string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, listed = batch.column(2)[i].as_py().encode().split(), batch.column(3)[i].as_py()
                at = pa.array([i] * len(listed), pa.int64())
                joined = [b" ".join(words[b * GRID : (b + 1) * GRID]).decode() for b in listed]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(listed, pa.int32()), pa.array(joined, pa.string())], names=schema.names)

    return shared.map_arrow(beside, run, schema)


def with_source_words(df: DataFrame, spans: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """(doc_id, row, pieces): what is needed to verify the spans of a document's row by their source coordinates: the words
    that the source has there, in pieces."""
    pieces = scratch.table(_pieces(spans))
    asked = pieces.select("source", "source_row", "block").distinct()
    asked = asked.groupBy(F.col("source").alias("doc_id"), F.col("source_row").alias("row")).agg(F.collect_list("block").alias("blocks"))
    words = scratch.table(_source_blocks(_beside(df, scratch.table(asked), "blocks")))
    answered = pieces.join(words, ["source", "source_row", "block"])
    return answered.groupBy("doc_id", "row").agg(F.collect_list(F.struct("span", "start", "n", "offset", "words")).alias("pieces"))


def _equal(words: list[bytes], piece: dict) -> Iterator[tuple[int, int]]:
    """Where the document's words are those of the source, from and to."""
    at, n, theirs = piece["start"], piece["n"], piece["words"].encode().split()[piece["offset"] :]
    if words[at : at + n] == theirs[:n]:
        yield at, at + n
        return
    for i, (a, b) in enumerate(zip(words[at : at + n], theirs)):
        if a == b:
            yield at + i, at + i + 1


def _verified(words: list[bytes], pieces: list[dict], window: int):
    """Which words are in runs of a window or more that are equal to the source's."""
    import numpy as np

    gone = np.zeros(len(words), bool)
    span, begin, end = None, 0, 0
    for piece in sorted(pieces, key=lambda p: (p["span"], p["start"])):
        for a, b in _equal(words, piece):
            if piece["span"] != span or a > end:
                span, begin, end = piece["span"], a, b
            end = max(end, b)
            if end - begin >= window:
                gone[begin:end] = True
    return gone


def _kept(text: str, pieces: list | None, window: int) -> tuple[int, int, str, str]:
    """Words, words removed, the kept words joined by one space, and the text without the removed words."""
    words = text.encode().split()
    if not pieces:
        return len(words), 0, b" ".join(words).decode(), text
    import re

    keep = (~_verified(words, pieces, window)).tolist()
    left = [w for w, k in zip(words, keep) if k]
    raw, cut, at = text.encode(), [], 0
    for m, k in zip(re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw), keep):
        if k:
            cut.append(raw[at : m.end()] if at is not None else raw[m.start() : m.end()])
            at = m.end()
        else:
            at = None
    return len(words), len(words) - len(left), b" ".join(left).decode(), b"".join(_spaced(cut)).decode()


def _spaced(pieces: list[bytes]) -> Iterator[bytes]:
    for i, piece in enumerate(pieces):
        yield b" " + piece if i and piece[:1] not in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") else piece


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of df, and n_words, n_removed, kept_words (joined by one space) and kept_text (white space between
    kept words as it was, one space where words went).

    A word goes if a window that covers it, `window` consecutive words of its document, also starts in a document
    of smaller id. Windows are judged on the texts as given. Words are parted by ASCII white space and compared
    as they are. Ids may be of any type with an order. A null text has no words; rows of null id neither lose words nor
    count as earlier; rows that share an id don't count as earlier to each other. Texts shorter than a window lose
    nothing. An empty table gives an empty table. Columns of df may have any names; the added ones replace columns of
    the same name.
    """
    spark = df.sparkSession
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType()), T.StructField("kept_text", T.StringType())]
    kept = [c for c in df.columns if c not in [f.name for f in added]]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{id_col}`").alias("id"), shared.text_of(text_col).alias("text"))
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    with shared.Scratch(spark) as scratch:
        spans = scratch.table(repeated_spans(texts, scratch, window))
        listed = scratch.keep(with_source_words(texts, spans, scratch))
    joined = plain.join(listed, (F.col("id") == F.col("doc_id")) & (F.crc32(F.col("text").cast("binary")) == F.col("row")), "left").drop("id", "doc_id", "row")
    joined = joined.select(*[f"c{i}" for i in range(len(kept))], "pieces", "text")
    schema = T.StructType([*[T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)], *added])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.slices(batch, width + 1):
                found = [_kept(t, s, window) for t, s in zip(part.column(width + 1).to_pylist(), part.column(width).to_pylist())]
                made = [pa.array([x[i] for x in found], arrow.field(width + i).type) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], schema=arrow)

    return shared.map_arrow(joined, run, schema).toDF(*kept, *[f.name for f in added])
