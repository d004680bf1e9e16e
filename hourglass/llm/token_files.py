"""Token ids in Parquet files: a list column of ids beside plain metadata columns, in id order, with controlled row groups and pages."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hourglass.llm.common import WORD_PATTERN, ChunkTokens, WordRanks, WordTokens, buckets_wanted, id_splits, library_encoder, range_of, shared_folder, sliced

SCHEMA = "file int, place long, doc_id long, n_tokens long, start_in_file long, tokens array<int>"


@lru_cache(maxsize=4)
def _tokens(path: str, pattern: str, lead: bool) -> ChunkTokens | WordTokens | WordRanks:
    if lead:
        return ChunkTokens(library_encoder(path, pattern, False), lead)
    return WordRanks(path) if pattern == WORD_PATTERN else WordTokens(path, pattern)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, pattern: str, lead: bool, end_id: int = 2, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10) -> str:
    """Write ids of every text to ``folder`` as Parquet files whose rows ascend by doc_id, files ascending by their ``file`` number.

    Row groups and pages have the given sizes; ids are dictionary-encoded (16 bits an id for vocabularies of this size),
    doc_id, place and start are delta-encoded (format version 2), and Parquet adds page indexes, so that a doc_id filter
    reads few pages and a metadata query reads no ids. NULL text gives the end id alone; equal ids are ordered by text;
    a NULL doc_id comes first. Ranges of ids are cut by row count, so a repeated id is the only thing that cannot be split.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    splits = id_splits(docs.select("doc_id"), buckets_wanted(spark))
    rows = docs.select(range_of(F.col("doc_id"), splits).alias("file"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder, file, place, start = _tokens(vocabulary, pattern, lead), -1, 0, 0
        for batch in batches:
            for part in sliced(batch, 64):
                files, ids = part.column(0).to_pylist(), [c + end_id.to_bytes(4, "little") for c in coder(part.column(2).to_pylist())]
                sizes = [len(c) // 4 for c in ids]
                places, starts = [], []
                for f, n in zip(files, sizes, strict=True):
                    if f != file:
                        file, place, start = f, 0, 0
                    places.append(place)
                    starts.append(start)
                    place, start = place + 1, start + n
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(places, pa.int64()), part.column(1), pa.array(sizes, pa.int64()), pa.array(starts, pa.int64()), lists], names=["file", "place", "doc_id", "n_tokens", "start_in_file", "tokens"])

    settings = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 2000, "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "parquet.dictionary.page.size": 1 << 20}
    dealt.mapInArrow(run, SCHEMA).write.options(**{k: str(v) for k, v in settings.items()}).parquet(folder)
    return folder


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens of every document, without reading any id.

    Offsets of files come from one sum per file; their running total goes over the files (a number fixed by the settings).
    """
    files = spark.read.schema(SCHEMA).parquet(folder)
    sums = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(bases, "file").select("file", "place", "doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents of the files with their ids, all or those with low <= doc_id <= high (by page indexes)."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    wanted = F.lit(True) if low is None and high is None else F.col("doc_id").between(low if low is not None else -(2**63), high if high is not None else 2**63 - 1)
    return files.filter(wanted)


def with_crc(rows: DataFrame) -> DataFrame:
    """file, place and ids_crc32 (unsigned crc32 of the ids as little-endian unsigned 32-bit integers) of rows read with their ids."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            every = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(every[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), batch.column(5), pa.array(sums, pa.int64())], names=["file", "place", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])

    return rows.select("file", "place", "tokens", "doc_id", "start_in_file", "n_tokens").mapInArrow(run, "file int, place long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, vocabulary: str, pattern: str, lead: bool = False) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32 and the file of each document."""
    spark = docs.sparkSession
    folder = write_tokens(docs, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}", vocabulary, pattern, lead)
    sums = read_tokens(spark, folder).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return with_crc(read_tokens(spark, folder)).join(bases, "file").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", "file")
