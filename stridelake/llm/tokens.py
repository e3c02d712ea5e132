"""Token ids of documents as compressed frames with a shared dictionary.

A store is a folder with two Parquet tables:

``dictionary``  one row: ``hash`` (sha256 of the bytes), ``bytes``, ``width`` (bytes of an id).
``blocks``      one row per run of documents: ``shard``, ``block``, ``dictionary`` (hash), ``n_ids``,
                ``first_doc``, ``last_doc``, ``payload`` (frames one after another) and, per document, the
                index arrays ``doc_ids``, ``starts`` (ids before it in its shard), ``counts``, ``offsets``, ``sizes``.

Every document is its own zstandard frame of little-endian ids, so reading one document costs one frame of its block;
``first_doc``/``last_doc`` prune blocks by Parquet statistics.  Documents are in ascending ``doc_id`` order over shards
and blocks (null first; repeated ids in the order of their text).  A null text counts as empty and holds the end id only.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from stridelake.llm.segments import Encoder

#: Documents whose id arrays train the dictionary (about), the bytes that one of them and all together give at most.
DICTIONARY_DOCUMENTS, DICTIONARY_SLICE_BYTES, DICTIONARY_SAMPLE_BYTES, DICTIONARY_BYTES = 4000, 4 << 10, 8 << 20, 112 << 10
#: Uncompressed id bytes after which a block ends.
BLOCK_BYTES = 4 << 20

_BLOCKS = (
    "shard int, block int, dictionary string, n_ids long, first_doc long, last_doc long, payload binary, doc_ids array<long>, "
    "starts array<long>, counts array<long>, offsets array<long>, sizes array<long>"
)


def _sample(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> list[bytes]:
    """Id arrays picked and ordered by a hash of the row, so that every partition has its share; of a long one, the
    ``DICTIONARY_SLICE_BYTES`` at a place that the hash names."""
    n = docs.count()
    place = F.xxhash64("doc_id", "text")
    keep = F.pmod(place, F.lit(1_000_000)) < int(1_000_000 * DICTIONARY_DOCUMENTS / max(n, 1)) + 1

    def encode(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows = []
            for ids, at in zip(encoder(batch.column("text")), batch.column("place").to_pylist()):
                raw, room = np.append(ids, end_id).astype(f"<u{width}"), DICTIONARY_SLICE_BYTES // width
                start = at % (len(raw) - room + 1) if len(raw) > room else 0
                rows.append(raw[start : start + room].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("place")], names=["ids", "place"])

    rows = docs.where(keep).select("text", place.alias("place")).mapInArrow(encode, "ids binary, place long").orderBy("place").limit(2 * DICTIONARY_DOCUMENTS)
    sample, total = [], 0
    for row in rows.toLocalIterator():
        if total + len(row.ids) <= DICTIONARY_SAMPLE_BYTES:
            sample.append(bytes(row.ids))
            total += len(row.ids)
    return sample


def train_dictionary(sample: list[bytes]) -> bytes:
    """A zstandard dictionary; of too few or too small samples, their bytes as they are (perhaps none)."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, vocabulary: int = 50257) -> str:
    """Encode ``doc_id, text`` into a store at ``folder``; other columns are left out.  Returns the folder.

    The dictionary is trained on slices of the id arrays of about ``DICTIONARY_DOCUMENTS`` documents picked by hash (it
    decides sizes only, never contents).  One shuffle by range of ``doc_id``; a repeated id is spread by its text's hash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(_sample(docs, tokenizer, end_id, width))
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary, width)], "hash string, bytes binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")

    def compress(batches):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared is not None:
            shared.precompute_compress(level=3)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=shared) if shared is not None else zstandard.ZstdCompressor(level=3)
        encoder, shard, block, before = Encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs_, starts, counts, offsets, frames, at, raw = [], [], [], [], [], 0, 0

        def flush():
            known = [d for d in docs_ if d is not None] or [None]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([digest]), pa.array([sum(counts)], pa.int64()),
                    pa.array(known[:1], pa.int64()), pa.array(known[-1:], pa.int64()), pa.array([b"".join(frames)], pa.binary()),
                    *(pa.array([x], pa.list_(pa.int64())) for x in (docs_, starts, counts, offsets, [len(f) for f in frames])),
                ],
                names=[c.split()[0] for c in _BLOCKS.split(", ")],
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text"))):
                data = np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()
                frame = squeeze.compress(data)
                docs_.append(doc_id)
                starts.append(before)
                counts.append(len(ids) + 1)
                offsets.append(at)
                frames.append(frame)
                before, at, raw = before + len(ids) + 1, at + len(frame), raw + len(data)
                if raw >= BLOCK_BYTES:
                    yield flush()
                    block += 1
                    docs_, starts, counts, offsets, frames, at, raw = [], [], [], [], [], 0, 0
        if docs_:
            yield flush()

    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    ranged.mapInArrow(compress, _BLOCKS).write.parquet(f"{folder}/blocks")
    return folder


def _opened(dictionary: bytes, wanted: str):
    import zstandard

    if hashlib.sha256(dictionary).hexdigest() != wanted:
        raise ValueError("the store's dictionary does not match its hash")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def read_tokens(spark: SparkSession, folder: str, per_document, schema: str, blocks: DataFrame | None = None) -> DataFrame:
    """``doc_id, start`` and what ``per_document(ids: uint32 array) -> tuple`` returns (columns of ``schema``), from the files.

    ``start`` counts the ids of all documents before it.  ``blocks`` may be a filtered ``read_blocks``.
    """
    first = spark.read.parquet(f"{folder}/dictionary").first()
    digest, dictionary, width = first["hash"], bytes(first["bytes"]), first["width"]
    everything = read_blocks(spark, folder)
    blocks = everything if blocks is None else blocks
    # One row per shard: the number of write tasks.
    base = everything.groupBy("shard").agg(F.sum("n_ids").alias("__n")).select(
        "shard", F.coalesce(F.sum("__n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    names = [c.split()[0] for c in schema.split(", ")]

    def expand(batches):
        for batch in batches:
            for row in batch.to_pylist():
                opened = _opened(dictionary, row["dictionary"])
                made = []
                for offset, size in zip(row["offsets"], row["sizes"]):
                    ids = np.frombuffer(opened.decompress(row["payload"][offset : offset + size]), f"<u{width}").astype("<u4")
                    made.append(per_document(ids))
                columns = {"doc_id": row["doc_ids"], "start": [row["__base"] + s for s in row["starts"]]}
                columns |= {name: [m[i] for m in made] for i, name in enumerate(names)}
                yield pa.RecordBatch.from_pylist([dict(zip(columns, values)) for values in zip(*columns.values())])

    return blocks.join(base, "shard").mapInArrow(expand, f"doc_id long, start long, {schema}")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, start, ids`` of a few documents: other blocks are pruned by their id range."""
    near = F.lit(False)
    for doc_id in doc_ids:
        near |= (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)
    found = read_tokens(spark, folder, lambda ids: (ids.tolist(),), "ids array<long>", read_blocks(spark, folder).where(near))
    return found.where(F.col("doc_id").isin(*doc_ids))


def token_digest(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write a store and return, from its files: doc_id, start, n_tokens, ids_crc32."""
    write_tokens(docs, folder, tokenizer)
    digest = read_tokens(docs.sparkSession, folder, lambda ids: (len(ids), zlib.crc32(ids.tobytes())), "n_tokens long, ids_crc32 long")
    return digest.select("doc_id", "start", "n_tokens", "ids_crc32")
