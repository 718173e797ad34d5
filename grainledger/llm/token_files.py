"""Token ids in flat binary files, with 64-bit offsets of documents, ordered by document id.

Format of a data set in one folder: shard ``k`` has ``ids-k.bin``, its documents' ids one after the other as
little-endian unsigned integers of 16 bits (32 where the vocabulary needs it), and ``docs-k.bin``, for each
document three little-endian signed 64-bit integers: its id, the offset in the shard of its first id, and the
offset after its last. Shards hold ascending ranges of ids. The place of a shard's first id in the whole data
set, its base, is the sum of the lengths of the shards before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import parts_for, shared_folder, table
from grainledger.llm.token_ids import crc_of_ids, encoder

END = 1
#: Texts whose words are looked up together.
TOGETHER = 1024
_NO_ID = np.iinfo(np.int64).min
WRITTEN = "shard int, n_docs long, n_ids long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", shard_bytes: int = 24 << 20, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[int, int, int, int, int]]:
    """Writes the files; gives (shard, documents, ids, bytes of an id, base) of each shard that has documents.

    A task writes each file under a name of its own attempt and renames it when whole, so a task that is run
    again, after a lost executor say, replaces it by the same bytes. A null text is empty; null ids stand first,
    as the smallest integer. Rows that repeat an id are ordered by text. Other columns are not read.
    """
    shards, _ = parts_for(docs, text_column, shard_bytes)
    # two copies of the key: the sort's own tie-break by text must not decide the shard
    ordered = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        files.create_dir(root)
        encode, task = encoder(tokenizer, False), TaskContext.get()
        shard, end = task.partitionId(), np.array([END], encode.dtype).tobytes()
        here = f"{root}/.{shard}-{task.taskAttemptId()}"
        index, total = [], 0
        with files.open_output_stream(f"{here}.ids") as out:
            for batch in batches:
                for at in range(0, len(batch), TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode.encode_many(part.column(1).to_pylist())):
                        out.write(ids)
                        out.write(end)
                        n = len(ids) // encode.dtype.itemsize + 1
                        index.append((_NO_ID if doc_id is None else doc_id, total, total + n))
                        total += n
        if index:
            with files.open_output_stream(f"{here}.docs") as out:
                out.write(np.array(index, "<i8").tobytes())
            files.move(f"{here}.ids", f"{root}/ids-{shard:06d}.bin")
            files.move(f"{here}.docs", f"{root}/docs-{shard:06d}.bin")
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((shard, pa.int32()), (len(index), pa.int64()), (total, pa.int64()), (encode.dtype.itemsize, pa.int32()))], names=["shard", "n_docs", "n_ids", "width"])
        else:
            files.delete_file(f"{here}.ids")

    base, out = 0, []
    for row in sorted(ordered.mapInArrow(write, WRITTEN).collect()):  # one small row for each shard
        out.append((*row, base))
        base += row["n_ids"]
    return out


def _array(files: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is a local or mounted one, else read."""
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_ids(spark: SparkSession, folder: str, shards: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """One row for each document, from the files: id, place of its first id in the data set, ids, their crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _array(files, f"{root}/ids-{row['shard']:06d}.bin", f"<u{row['width']}")
                index = _array(files, f"{root}/docs-{row['shard']:06d}.bin", "<i8").reshape(-1, 3)
                for at in range(0, len(index), 4096):
                    part = index[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part[:, 0], pa.int64(), mask=part[:, 0] == _NO_ID),
                            pa.array(part[:, 1] + row["base"]),
                            pa.array(part[:, 2] - part[:, 1]),
                            pa.array([crc_of_ids(ids[a:b]) for _, a, b in part], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = spark.createDataFrame(shards, f"{WRITTEN}, base long")
    return rows.repartition(max(1, len(shards))).mapInArrow(read, READ)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    return read_ids(spark, folder, write_ids(table(spark, sf_dir, "documents"), folder))
