"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations alone.

Test items are short and documents long, so Jaccard similarity says little; what counts is containment, the share
of an item's shingles that the document has. Items are put into partitions by their number of shingles. The sketch
of an item is its k least shingle hashes (a bottom-k MinHash), k depending on the partition: at a containment of t,
an item of m shingles misses (1 - t) m of them at most, so of its floor((1 - t) u) + 1 least, u >= m the
partition's upper bound, the document has one. Any document that contains an item thus meets its sketch: the
search loses nothing. Pairs that meet are verified by the exact containment of shingles, as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words of a shingle, and the least containment.
SHINGLE = 5
CONTAINMENT = 0.8

#: Item shingles (16 bytes each) up to which the sketch is broadcast; beyond, the join shuffles by hash.
SKETCH_ROWS = 500_000


def _words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, size: int, made) -> Column:
    """made(the words of a shingle) of each shingle of `size` words; none if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - F.lit(size))
    return F.when(F.size(words) >= size, F.transform(at, lambda i: made([F.get(words, i + F.lit(j)) for j in range(size)]))).otherwise(F.array())


def _hashed(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _joined(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def items(benchmark: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(item, item_id, size, shingles): distinct shingles of each distinct item that has a word. An item of fewer
    words than a shingle has is one shingle of `size` words."""
    found = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    found = found.withColumn("item", F.xxhash64("item_id", "text")).withColumn("words", _words(F.col("text"))).where(F.size("words") > 0)
    sizes = [_shingles(F.col("words"), k, _joined) for k in range(1, shingle)]
    whole = F.when(F.size("words") >= shingle, _shingles(F.col("words"), shingle, _joined))
    for k, made in enumerate(sizes, 1):
        whole = whole.when(F.size("words") == k, made)
    found = found.select("item", "item_id", F.least(F.size("words"), F.lit(shingle)).alias("size"), whole.alias("shingles"))
    return found.withColumn("shingles", F.array_distinct("shingles"))


def sketches(found: DataFrame, containment: float) -> DataFrame:
    """(hash, item): the bottom-k sketch of each item; partitions are of sizes up to 1, 2, 4, 8 and so on."""
    hashes = F.transform("shingles", lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(j)) for j in range(SHINGLE)]))
    bound = F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles"))))
    k = F.floor((1 - F.lit(containment)) * bound + F.lit(1e-9)).cast("int") + 1
    return found.select("item", F.explode(F.slice(F.array_sort(hashes), F.lit(1), k)).alias("hash")).distinct()


def contained_items(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT
) -> DataFrame:
    """(id_col, item_col, n_shingles, n_shared, containment) of each document and each item of which it has at least
    the share `containment` of the distinct shingles of `shingle` words.

    Words are runs of letters and digits, lower-cased. An item of fewer words is found as a whole; items without a
    word (null, empty) are never found, nor is anything in a document without a word. Repeated items count once;
    items that share an id are searched each by itself, and so are documents. Null ids stay. Other columns aren't
    read. Empty tables give an empty table. Only documents' shingle hashes that meet a sketch leave the scan.
    """
    if shingle != SHINGLE:
        raise ValueError(f"shingles have {SHINGLE} words")
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    with shared.Scratch(spark) as scratch:
        found = scratch.table(items(benchmark, item_col, item_text_col, shingle))
        sizes = sorted(r[0] for r in found.select("size").distinct().collect())  # five at most
        sketch = shared.sized(scratch.table(sketches(found, containment)), SKETCH_ROWS)
        words = docs.select("doc_id", F.xxhash64("text").alias("row"), _words(F.col("text")).alias("words"))
        hashed = [_shingles(F.col("words"), k, lambda w: F.xxhash64(*w, *[F.lit(None).cast("string")] * (shingle - len(w)))) for k in sizes]
        every = F.concat(*hashed) if len(hashed) > 1 else hashed[0] if hashed else F.array().cast("array<bigint>")
        met = words.select("doc_id", "row", F.explode(every).alias("hash")).join(sketch, "hash")
        candidates = scratch.table(met.groupBy("doc_id", "row", "item").agg(F.lit(1).alias("one")).drop("one"))
        # The exact check: shingles that candidate pairs need, and those that their documents have.
        shingles = found.select("item", F.explode("shingles").alias("shingle"))
        need = candidates.join(shared.sized(shingles, SKETCH_ROWS), "item")
        searched = shared.sized(candidates.select("doc_id", "row").distinct())
        texts = docs.withColumn("row", F.xxhash64("text"))
        chosen = texts.join(searched, texts["doc_id"].eqNullSafe(searched["doc_id"]) & (texts["row"] == searched["row"]), "left_semi")
        chosen = chosen.select("doc_id", "row", _words(F.col("text")).alias("words"))
        strings = [_shingles(F.col("words"), k, _joined) for k in sizes]
        every = F.concat(*strings) if len(strings) > 1 else strings[0] if strings else F.array().cast("array<string>")
        have = chosen.select("doc_id", "row", F.explode(F.array_distinct(every)).alias("shingle")).distinct()
        have = have.join(shared.sized(shingles.select("shingle").distinct(), SKETCH_ROWS), "shingle", "left_semi")
        both = need.join(have.withColumnsRenamed({"doc_id": "d", "row": "r", "shingle": "s"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("shingle") == F.col("s")))
        counts = both.groupBy("doc_id", "row", "item").agg(F.count("*").alias("n_shared"))
        whole = found.select("item", "item_id", F.size("shingles").cast("long").alias("n_shingles"))
        pairs = counts.join(shared.sized(whole), "item").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
        pairs = scratch.keep(pairs.where(F.col("containment") >= containment).select("doc_id", "item_id", "n_shingles", "n_shared", "containment"))
    return pairs.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose document contains no item. Rows that share a contaminated id all go."""
    hit = contained_items(df, benchmark, id_col, text_col).select(F.col(id_col).alias("__id")).distinct()
    return df.join(hit, df[id_col].eqNullSafe(hit["__id"]), "left_anti")
