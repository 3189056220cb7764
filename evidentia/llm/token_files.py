"""Token-id files: one zstandard frame per document under a shared dictionary."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens
from ._shared import bound_batches, large, partitions, shared_dir, slices, utf8, whole_ids

#: Documents whose ids train the dictionary, bytes used of each (from a place that a hash chooses), and the dictionary's size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 64 << 10
#: A block is closed beyond so many bytes of frames.
BLOCK_BYTES = 4 << 20
#: Bytes of text of a shard, about, and bytes for which a document weighs once more where shards are cut.
SHARD_BYTES, WEIGHT = 256 << 20, 64 << 10
LEVEL = 3
#: Stands for a null id, before all others.
NO_ID = -(2**63)

BLOCK = "shard int, block int, low long, high long, first long, n_docs long, n_tokens long, id_bytes int, dictionary string, ids binary, tokens binary, offsets binary, frames binary"


class Shards:
    """Shards by ranges of ids, from cuts of about equal weight. An id that several cuts fall on has as many shards of its
    own, which its rows are dealt to by a hash of their bytes."""

    def __init__(self, cuts: list[int]):
        self.bounds, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.own = np.where(times > 1, times, 0)
        # The range up to a bound comes first, then the bound's own shards.
        self.base = np.arange(len(times) + 1) + np.concatenate([[0], np.cumsum(self.own)])
        self.count = int(self.base[-1]) + 1

    def of(self, ids: np.ndarray, rows: list[bytes]) -> np.ndarray:
        at = np.searchsorted(self.bounds, ids, "left")
        out = self.base[at]
        inside = np.minimum(at, len(self.bounds) - 1)
        hot = np.flatnonzero((at < len(self.bounds)) & (self.bounds[inside] == ids) & (self.own[inside] > 0)) if len(self.bounds) else []
        for k in hot:
            out[k] += 1 + (xxhash.xxh3_64_intdigest(rows[k]) * int(self.own[at[k]]) >> 64)
        return out.astype(np.int32)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary of the id arrays of a bounded sample: the SAMPLE_DOCS documents with the
    smallest hashes of their ids, SAMPLE_BYTES of each. Too little to train on: empty, no dictionary."""
    # Ids are chosen first and texts fetched for them alone, so that the driver gets no more than the sample.
    chosen = docs.select(F.xxhash64("id").alias("h"), "id").distinct().orderBy("h", "id").limit(SAMPLE_DOCS).select("id")
    text, h = F.coalesce("text", F.lit("")), F.xxhash64("id")
    piece = F.substring(text, F.lit(1) + F.pmod(h, F.greatest(F.length(text) - 4 * SAMPLE_BYTES, F.lit(1))).cast("int"), F.lit(4 * SAMPLE_BYTES))
    # One text of each id, the same whatever the order of rows.
    texts = docs.join(F.broadcast(chosen), "id", "left_semi").groupBy(h.alias("h")).agg(F.min(piece).alias("text"))
    rows = sorted(texts.collect(), key=lambda r: (r["h"], r["text"]))
    held = _tokens.encoder(tokenizer)
    ids, first = held.encode(*utf8(pa.array([r["text"] for r in rows], pa.large_string())))
    samples = [x for a, b in zip(first[:-1], first[1:], strict=True) if (x := ids[a:b].tobytes()[:SAMPLE_BYTES])]
    try:
        size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 10))
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode documents and write their ids under `path` in ascending order of document id.

    The format is a table of blocks (Parquet as the container, so that any store Spark writes to will
    do and lost tasks are committed once): a shard holds a range of document ids; a block holds, for
    its documents in order, ids (int64), tokens (uint32 counts), offsets (uint64, one more than
    documents) into frames, and the SHA-256 of the dictionary. `path`/dictionary has that dictionary.
    A frame is one document's ids, little-endian, id_bytes each. Each block is a page of its own and
    tells its least and greatest id, so reading one document takes one block (of BLOCK_BYTES or one document).

    Null texts count as empty; a document then has only end_id. Rows with equal ids stay, in an order that
    their bytes decide; rows without an id come first (the least 64-bit integer stands for it). Ids are whole numbers;
    others are refused (TypeError). An empty table writes no blocks. Shards are ranges of ids of about as many bytes each;
    an id that outweighs one has several, parted by a hash (Shards), so only its equal rows share one. Long texts are encoded whole. Returns `path`.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    whole_ids(docs, id_col)
    proof = spark.sparkContext.broadcast(_tokens.prove(tokenizer))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    # Shards follow the input's bytes: a document counts once, and once more for each WEIGHT bytes of it.
    n = max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    weighed = docs.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / WEIGHT).cast("int"))).alias("part"))
    cuts = weighed.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], min(100 * n, 10_000_000))).first()[0] or []
    shards = Shards(cuts)

    def encode(batches):
        held = _tokens.encoder(tokenizer, proof.value)
        end = b"" if end_id is None else np.array([end_id], held.dtype).tobytes()
        for batch in batches:
            data, offsets = utf8(large(batch.column(1)))
            ids = np.asarray(batch.column(0), np.int64)
            for a, b in slices(offsets, _tokens.STEP_BYTES):
                found, first = held.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                whole, cut = found.tobytes(), (first * held.dtype.itemsize).tolist()
                each = [whole[x:y] + end for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shards.of(ids[a:b], each)), pa.array(ids[a:b]), pa.array(each, pa.binary())], ["shard", "id", "ids"])

    size = _tokens.encoder(tokenizer).dtype.itemsize

    def pack(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=data) if data else zstandard.ZstdCompressor(level=LEVEL)
        shard, block, first, docs_, tokens, frames, filled = None, 0, 0, [], [], [], 0

        def close():
            offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
            row = [[shard], [block], [docs_[0]], [docs_[-1]], [first], [len(docs_)], [sum(tokens)], [size], [digest], [np.array(docs_, "<i8").tobytes()], [np.array(tokens, "<u4").tobytes()], [offsets.tobytes()], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for at, i, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if docs_ and (at != shard or filled >= BLOCK_BYTES):
                    yield close()
                    block, first = (block + 1, first + sum(tokens)) if at == shard else (0, 0)
                    docs_, tokens, frames, filled = [], [], [], 0
                shard = at
                frame = press.compress(ids)
                docs_.append(i)
                tokens.append(len(ids) // size)
                frames.append(frame)
                filled += len(frame)
        if docs_:
            yield close()

    # A task for each shard, so that ranges of about as many bytes each stay apart.
    rows = docs.mapInArrow(encode, "shard int, id long, ids binary").repartitionById(shards.count, F.col("shard")).sortWithinPartitions("shard", "id", "ids")
    rows.mapInArrow(pack, BLOCK).write.option("parquet.page.row.count.limit", "1").parquet(f"{path}/blocks")
    return path


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers). Refuses blocks of another dictionary."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary = row["dictionary"], bytes(row["data"])
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary is damaged")
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # Two levels of prefix sums: a block knows its place within the shard; shards are as few as partitions.
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip([s for s, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist(), strict=False))

    def unpack(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        open_ = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
        for batch in batches:
            held = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                if held["dictionary"][k].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                ids = np.frombuffer(held["ids"][k].as_buffer(), "<i8")
                tokens = np.frombuffer(held["tokens"][k].as_buffer(), "<u4").astype(np.int64)
                offsets = np.frombuffer(held["offsets"][k].as_buffer(), "<u8").astype(np.int64).tolist()
                frames = memoryview(held["frames"][k].as_buffer())
                kind = f"<u{held['id_bytes'][k].as_py()}"
                crc = [zlib.crc32(np.frombuffer(open_.decompress(frames[a:b]), kind).astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                start = before[held["shard"][k].as_py()] + held["first"][k].as_py() + np.cumsum(tokens) - tokens
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    out = blocks.mapInArrow(unpack, "id long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "start", "n_tokens", "ids_crc32")


def blocks_with(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The blocks whose ids reach over this one: the range is pushed down to the pages, so no other block is read."""
    held = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    return held.where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).select("ids", "offsets", "frames", "id_bytes", "dictionary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id: the block that has them (several only for equal ids), of it its index and their
    own frames. Refuses a block of another dictionary."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary = row["dictionary"], bytes(row["data"])

    def find(batches) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        open_ = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(4)[k].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                ids, offsets, frames = (memoryview(batch.column(i)[k].as_buffer()) for i in range(3))
                at = np.flatnonzero(np.frombuffer(ids, "<i8") == doc_id)
                cut = np.frombuffer(offsets, "<u8").astype(int)
                got = [open_.decompress(frames[cut[i] : cut[i + 1]]) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(3)[k].as_py()] * len(got), pa.int32()), pa.array(got, pa.binary())], ["w", "x"])

    return [np.frombuffer(bytes(r["x"]), f"<u{r['w']}") for r in blocks_with(spark, path, doc_id).mapInArrow(find, "w int, x binary").collect()]


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(docs, tokenizer, path, end_id))
