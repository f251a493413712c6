"""SimHash near-duplicates through an inverted index of fingerprint bytes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import components

#: Fingerprints that differ in so many bits at most are linked.
BITS = 2

#: Pairs are tallied in posting lists of up to so many fingerprints; a longer list is split by further bytes.
LONG_LIST = 16

_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of the text's word shingles, repeats included, as an unsigned 64-bit integer.

    A-Z are lower-cased; words are parted by ASCII white space. A bit is set if it is in over half the XXH64 of
    the shingles. Fewer words than a shingle has: the whole sequence is the one shingle; no word: 0.
    """
    import numpy as np
    from xxhash import xxh64_digest

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return int.from_bytes(xxh64_digest(b" ".join(found), seed), "big")
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    first = [0, *(ends[:-words] + 1).tolist()]
    last = ends[words - 1 :].tolist()
    n, counts = len(first), np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        digests = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp (long, the fingerprint's two's complement) of each row."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        found = (fingerprint(t) for t in texts)
        return [pa.array([x - (1 << 64) if x >> 63 else x for x in found], pa.int64())]

    return shared.text_map(df, text_col, [id_col], [T.StructField("fp", T.LongType())], make)


def _mask(places: list[int], width: int) -> int:
    return sum(((1 << width) - 1) << (width * p) for p in places)


def _levels() -> list[list[list[int]]]:
    """Masks of the fingerprint bits that a posting list agrees in. levels[k][i]: those that list kind i of the level before
    is split into; the first level has one kind.

    Two differing bits touch two of four parts at most, so two of the four agree: of four byte pairs; then of the four
    bytes that are left, so that six bytes agree; then of the four half bytes of the last two bytes. Linked
    fingerprints thus share a list of each level. A list of the last one has 256 fingerprints at most.
    """
    halves = list(combinations(range(4), 2))
    first = [_mask([2 * p + q for p in pair for q in (0, 1)], 8) for pair in halves]
    second, third = [], []
    for mask in first:
        free = [p for p in range(8) if not mask >> (8 * p) & 1]
        split = [mask | _mask([free[i] for i in pair], 8) for pair in halves]
        second.append(split)
        for inner in split:
            nibbles = [p for p in range(16) if not inner >> (4 * p) & 1]
            third.append([inner | _mask([nibbles[i] for i in pair], 4) for pair in halves])
    return [[first], second, third]


def _postings(fps: DataFrame, kinds: list[list[int]]) -> DataFrame:
    """(kind, key, fp): the posting lists of each fingerprint, one for each mask that its former kind is split into."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    lists = [F.array(*[F.struct(F.lit(i * len(masks) + j).alias("kind"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for j, m in enumerate(masks)]) for i, masks in enumerate(kinds)]
    chosen = lists[0] if len(lists) == 1 else F.get(F.array(*lists), F.col("kind"))
    return fps.select("fp", F.explode(chosen).alias("list")).select("list.kind", "list.key", "fp")


def _shared_bytes(difference: Column) -> Column:
    """How many of the eight positional bytes are the same."""
    same = [F.when(F.shiftrightunsigned(difference, 8 * i).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for i in range(8)]
    return sum(same[1:], same[0])


def links(fps: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """Pairs (a, b) of all distinct fingerprints that are linked.

    Fingerprints are posted by their bytes at given positions (_levels). In lists of up to LONG_LIST each pair's shared
    positional bytes are tallied; pairs with at least 8 - BITS, the fewest that linked ones have, are kept and
    their differing bits verified. A longer list is split by further bytes, at last by half bytes, into lists that again
    hold each linked pair. A fingerprint is in 216 lists of 256 at most, so rows are linear in the fingerprints.
    """
    found = []
    rows, levels = fps, _levels()
    for at, kinds in enumerate(levels):
        postings = _postings(rows, kinds)
        sizes = postings.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = scratch.table(postings.join(sizes, ["kind", "key"]))
        last = at == len(levels) - 1
        short = met if last else met.where(F.col("n") <= LONG_LIST)
        lists = short.groupBy("kind", "key").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
        pairs = lists.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
        difference = F.col("a").bitwiseXOR(F.col("b"))
        tallied = pairs.where(_shared_bytes(difference) >= 8 - BITS)
        found.append(tallied.where(F.bit_count(difference) <= BITS).select("a", "b"))
        rows = met.where(F.col("n") > LONG_LIST).select("kind", "fp")
        if last or shared.small(rows, 0):
            break
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id, the smallest id reachable over linked fingerprints.

    One row for each row of df. Rows of equal fingerprint are linked, texts without a word (null, empty) among
    them, with fingerprint 0. A null id stays as a row but is no component's id unless all its ids are null.
    Other columns of df aren't read. An empty table gives an empty table. Distinct fingerprints alone enter the
    search, so copies cost a partial aggregate; a fingerprint that a third of the rows have is a skewed join of
    16-byte rows, which Spark splits.
    """
    spark = df.sparkSession
    with shared.Scratch(spark) as scratch:
        marked = scratch.keep(fingerprints(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), "fp"))
        firsts = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
        edges = scratch.table(links(firsts.select("fp"), scratch))
        roots = components(edges, scratch)
        linked = scratch.table(firsts.join(roots, firsts["fp"] == roots["node"]).select("fp", "first", "root"))
        least = linked.groupBy("root").agg(F.min("first").alias("least"))
        moved = linked.join(least, "root").select("fp", "least")
        least_of = scratch.keep(firsts.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    found = marked.join(least_of, "fp")
    return found.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is its component's smallest, all columns. Of rows that share that id, all stay."""
    found = near_duplicates(df, id_col, text_col)
    first = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id")).distinct()
    return df.join(first, df[id_col].eqNullSafe(first["__id"]), "left_semi")
