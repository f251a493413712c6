"""Token ids of documents in Parquet list columns, for selective reads."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import shared, vocabulary
from .pretokens import MEMO_BYTES, MEMO_KEY, Encoder, byte_mapped, flat, listed, merged

#: Fixed value: how the byte-level pre-tokenizer of the library cuts texts.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: How the files are laid out. Token ids have a dictionary (65,536 ids at most take 16 bits each) and fall back to
#: delta encoding; ids and offsets of documents, which ascend, have delta encoding at once. Row groups hold
#: 32 MB; pages are small and have column and offset indexes, so that a reader of a few documents skips the others.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "compression": "zstd",
}


#: Fewer pieces than these are encoded at once: to look them up costs a hash table of all that are known.
LEAST_LOOKUP = 4096


class Known:
    """make(pieces), the lists of pieces of former calls kept in Arrow, about `bound` bytes. At the bound those go that weren't met again."""

    def __init__(self, make: Callable[[list[str]], pa.ListArray], bound: int = MEMO_BYTES):
        self.make, self.bound = make, bound
        self.names, self.lists, self.met = pa.array([], pa.string()), flat([]), np.zeros(0, bool)

    def __call__(self, pieces: list[str]) -> pa.ListArray:
        if len(pieces) < LEAST_LOOKUP:
            return self.make(pieces)
        names = pa.array(pieces, pa.string())
        found = pc.index_in(names, value_set=self.names)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        self.met[at[~new]] = True
        places = np.flatnonzero(new)
        at[places] = len(self.names) + np.arange(len(places))
        made = self.make([pieces[i] for i in places])
        out = pa.concat_arrays([self.lists, made]).take(pa.array(at))
        names = names.take(pa.array(places))
        short = pc.less_equal(pc.binary_length(names), MEMO_KEY)
        self._keep(names.filter(short), made.filter(short))
        return out

    def _keep(self, names: pa.Array, lists: pa.ListArray) -> None:
        more = names.nbytes + lists.nbytes
        if self.names.nbytes + self.lists.nbytes + more > self.bound:
            met = pa.array(self.met)
            self.names, self.lists = self.names.filter(met), self.lists.filter(met)
            self.met = np.zeros(len(self.names), bool)
            if self.names.nbytes + self.lists.nbytes + more > self.bound:
                return
        self.names, self.lists = pa.concat_arrays([self.names, names]), pa.concat_arrays([self.lists, lists])
        self.met = np.concatenate([self.met, np.zeros(len(names), bool)])


class LibraryEncoder:
    """Ids as the tokenizers library gives them for whole texts."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.model = self.tokenizer.model
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(data)
        pre = spec["pre_tokenizer"] or {}
        # Pre-tokens can be encoded one by one if nothing but the byte-level cut comes before the merges.
        self.by_piece = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        self.encoder = Encoder(BYTE_LEVEL_PATTERN, Known(self._pieces))

    def _pieces(self, pieces: list[str]) -> pa.ListArray:
        tokenize, ids, ends = self.model.tokenize, array("i"), array("i", [0])
        for p in pieces:
            ids.extend([t.id for t in tokenize(byte_mapped(p))])
            ends.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text; texts: strings without nulls. Texts with a special string go through the library whole."""
        if not self.by_piece:
            return listed([self._whole(t) for t in texts.to_pylist()])
        marked = np.zeros(len(texts), bool)
        for m in self.marks:
            marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(marked)
        if not len(at):
            return self.encoder(texts)
        coded = listed([self._whole(t) for t in texts.take(pa.array(at)).to_pylist()])
        return merged(len(texts), at, coded, self.encoder(texts.filter(pa.array(~marked))))


def with_end(lists: pa.ListArray, end_id: int) -> pa.ListArray:
    """The lists, end_id appended to each."""
    before = lists.offsets.to_numpy().astype(np.int64)
    ends = before - before[0] + np.arange(len(before))
    out = np.full(int(ends[-1]), end_id, np.int32)
    inside = np.ones(len(out), bool)
    inside[ends[1:] - 1] = False
    out[inside] = lists.flatten().to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def token_rows(df: DataFrame, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, shard, first, n_tokens, tokens) in ascending order of doc_id over all partitions.

    shard is the partition's number, first the number of ids before the document within it. Each document's ids
    end with end_id. Nulls come first, rows of equal id by their text. A null text counts as empty: end_id alone.
    Other columns of df aren't read. One shuffle by ranges of doc_id; texts are encoded after it.
    """
    data: Broadcast = vocabulary.load(df.sparkSession, vocab_path)
    ordered = df.select(F.col(f"`{id_col}`").alias("doc_id"), shared.text_of(text_col).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = T.StructType([ordered.schema["doc_id"], T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.once("library", data, LibraryEncoder)
        shard, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in shared.slices(batch, 1, shared.BULK_BYTES):
                tokens = with_end(encode(part.column(1)), end_id)
                ends = tokens.offsets.to_numpy().astype(np.int64)
                columns = [part.column(0), pa.array([shard] * len(tokens), pa.int32()), pa.array(first + ends[:-1]), pa.array(np.diff(ends)), tokens.cast(arrow.field(4).type)]
                first += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return shared.map_arrow(ordered, run, schema)


def write_store(df: DataFrame, path: str, vocab_path: str, end_id: int = 0, **columns: str) -> None:
    """Writes token_rows as Parquet under `path`, with LAYOUT. Shards are files, ascending in doc_id.

    Null and empty texts are the end id alone, rows of equal id are all written, very long texts are one row each; an
    empty table gives a store without rows.
    """
    with shared.early_shuffle_cleanup(df.sparkSession):
        token_rows(df, vocab_path, end_id, **columns).write.options(**LAYOUT).parquet(path)


def starts(rows: DataFrame, store: DataFrame) -> DataFrame:
    """rows, which have shard and first, with `start`: the number of ids of all documents before. Of the store it reads
    shard and n_tokens alone."""
    # One row for each file of the store; the running sum over them is the only ordered step.
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(shared.sized(base), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of every document. Columns and ranges of doc_id that aren't asked for aren't read."""
    store = spark.read.parquet(path)
    return starts(store, store).select("doc_id", "start", "n_tokens", "tokens")


def checksums(store: DataFrame) -> DataFrame:
    """`ids_crc32` in the place of `tokens`: crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [f for f in store.schema.fields if f.name != "tokens"]
    schema = T.StructType([*kept, T.StructField("ids_crc32", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            tokens = batch.column(batch.num_columns - 1)
            values, ends = tokens.values.to_numpy().astype("<u4", copy=False), tokens.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], schema=arrow)

    return shared.map_arrow(store.select(*[f.name for f in kept], "tokens"), run, schema)
