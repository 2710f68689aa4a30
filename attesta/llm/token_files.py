"""Token-id files: each document's ids compressed for itself, with a dictionary that all documents share.

A data set is a folder with two Parquet tables. ``dictionary`` holds the zstandard dictionary, its hash and the width of
an id. ``segments`` holds the documents in ascending order of id: a segment is a run of compressed documents one after
another with an index of their ids, lengths in tokens and byte offsets, so one short document is read by decompressing
its own bytes alone. A text's place among all ids is its place in its partition plus the ids of the partitions before.

The dictionary is trained on the ids of at most ``SAMPLE_DOCS`` documents, those with the smallest id hashes among the
texts of at most ``SAMPLE_BYTES`` bytes; too few samples give an empty dictionary. Null texts are empty and have the end
id alone; null ids come first; equal ids are ordered by a hash of their text. An empty table makes an empty data set. Texts
are read whole, and other columns are not looked at. Ids take two bytes, or four where the vocabulary needs them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.arrow_text import runs
from attesta.llm.shared import sample_rows, shared_dir
from attesta.llm.token_ids import encoder

SAMPLE_DOCS, SAMPLE_BYTES = 1000, 1 << 16
DICTIONARY_BYTES = 1 << 16
LEVEL = 3

SEGMENTS = (
    "part int, first_start long, dict_hash string, low_id long, high_id long, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, data binary"
)


def _ids_of(tokenizer: str, end_id: int):
    """A function from a run of rows to each row's ids, with the end id."""

    def own(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        ids, first = encoder(tokenizer).encode(data, offsets)
        for a, b in zip(first, first[1:], strict=False):
            yield np.append(ids[a:b], np.uint32(end_id))

    return own


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: str) -> bytes:
    ids_of = _ids_of(tokenizer, end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(width).tobytes() for x in ids_of(data, offsets)], pa.binary())], names=["ids"])

    some = docs.filter((F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text")
    some = sample_rows(some, SAMPLE_DOCS, "doc_id", "text").select("text")
    samples = [bytes(x["ids"]) for x in some.mapInArrow(work, "ids binary").collect()]
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **known), zstandard.ZstdDecompressor(**known)


def id_width(tokenizer: str, end_id: int) -> int:
    """2 or 4 bytes, as the largest id of the vocabulary, its added tokens and the end id need."""
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(largest, end_id) < 1 << 16 else 4


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the data set for ``docs`` (doc_id, text) to the new folder ``path``; an empty table makes an empty data set."""
    spark, id_bytes = docs.sparkSession, id_width(tokenizer, end_id)
    width = f"<u{id_bytes}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    head = spark.createDataFrame([(digest, bytearray(dictionary), id_bytes)], "dict_hash string, dictionary binary, id_bytes int")
    head.coalesce(1).write.parquet(f"{path}/dictionary")
    ids_of = _ids_of(tokenizer, end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, _ = _codec(dictionary)
        part, seen = TaskContext.get().partitionId(), 0
        for rows, data, offsets in runs(batches):
            ids = rows.column("doc_id").to_pylist()
            packed, n = [], []
            for own in ids_of(data, offsets):
                packed.append(squeeze.compress(own.astype(width).tobytes()))
                n.append(len(own))
            bounds = [x for x in ids if x is not None]
            cells = [part, seen, digest, min(bounds, default=None), max(bounds, default=None), ids, n, [0, *accumulate(map(len, packed))], b"".join(packed)]
            types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = [x.split()[0] for x in SEGMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=names)
            seen += sum(n)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(work, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents, or of those asked for.

    ``start`` counts the ids of all documents before. Only the segments that may hold the ids asked for are read, and
    only those documents are decompressed.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, width = bytes(head["dictionary"]), f"<u{head['id_bytes']}"
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    sizes = segments.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    totals = {x["part"]: x["n"] for x in sizes.collect()}  # a row for each partition written
    before = dict(zip(sorted(totals), accumulate([0, *(totals[k] for k in sorted(totals))]), strict=False))
    if doc_ids is not None:
        wanted = None
        for d in doc_ids:
            one = (F.col("low_id") <= d) & (F.col("high_id") >= d)
            wanted = one if wanted is None else wanted | one
        segments = segments.filter(F.lit(False) if wanted is None else wanted)
    asked = None if doc_ids is None else set(doc_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, open_ = _codec(dictionary)
        for b in batches:
            for x in b.to_pylist():
                if x["dict_hash"] != head["dict_hash"]:
                    raise ValueError(f"written with another dictionary: {x['dict_hash']}")
                start, rows = before[x["part"]] + x["first_start"], []
                for doc, n, a, z in zip(x["doc_ids"], x["n_tokens"], x["offsets"], x["offsets"][1:], strict=False):
                    if asked is None or doc in asked:
                        ids = np.frombuffer(open_.decompress(x["data"][a:z]), width).astype("<u4")
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32)))
                    start += n
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                keep = 4 + with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:keep], types[:keep], strict=True)], names=names[:keep])

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return segments.mapInArrow(work, out)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
