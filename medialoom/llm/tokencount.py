"""Token counts by a separator scan over flat token files.

A flat file holds ids of one width, documents after one another, each closed by the end id;
there is no index.  Files are cut into blocks of BLOCK ids; a task reads a block by its byte
range and finds all end ids with one vectorised comparison.  A document can begin in one block
and end in another: a prefix scan over the blocks of a file carries the number of ends and the
last end before each block, which closes the first document of the block and numbers the others.

Writing: every task writes one file under a name of its own and returns, for each document,
file, number in the file and doc_id; only the rows of successful tasks are committed, so files
of lost or repeated tasks are never read.

Defined results: a null text is an empty one: 0 tokens; ids after the last end of a file are a
document that is not ended; an empty file has no documents; a trailing part of an id is an
error; special strings in a text are ordinary text, so no text holds the end id; repeated rows
are counted one by one; very long texts are encoded whole, and their ids span blocks; an empty
table gives an empty one; columns other than doc_id and text are not looked at, whatever their
names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialoom.llm.bpe import chunks, vocabulary
from medialoom.llm.common import documents_of, file_system, fresh_path, saved, shuffle_partitions, spread
from medialoom.llm.dac import CHUNK_CHARS, library_ids

BLOCK = 2_000_000


def write_flat(docs: DataFrame, folder: str, name: str = "byte_bpe_50k.json", end_id: int = 50256, width: int = 2) -> DataFrame:
    """Writes flat files of `width`-byte ids; returns file, doc_no and doc_id of each document."""

    def run(batches):
        tok, kind = library_ids(vocabulary(name), ordinary=True), f"<u{width}"
        fs, path = file_system(f"{folder}/{uuid.uuid4().hex}.tok")
        out, at, uri = None, 0, f"{folder}/{path.rpartition('/')[2]}"
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                ids = np.frombuffer(b"".join(tok.encode(texts[a:b], end_id)), "<u4")
                if int(ids.max(initial=0)) >= 1 << (8 * width):
                    raise ValueError(f"an id does not fit in {width} bytes")
                out = out or fs.open_output_stream(path)
                out.write(ids.astype(kind).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(np.arange(at, at + n)), batch.column(0)], ["file", "doc_no", "doc_id"])
            at += n
        if out:
            out.close()

    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return saved(spread(documents_of(docs)).mapInArrow(run, "file string, doc_no long, doc_id long"), "flat-manifest")


def scan_flat(spark: SparkSession, files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, doc_no (from 0), start (in ids), n_tokens (without the end id) and ended, for each document of the files (column file)."""
    n = shuffle_partitions(spark)

    def sizes(batches):
        for batch in batches:
            uris = batch.column(0).to_pylist()
            lengths = []
            for uri in uris:
                fs, path = file_system(uri)
                size = fs.get_file_info(path).size
                if size % width:
                    raise ValueError(f"{uri} ends within an id")
                lengths.append(size // width)
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(lengths, pa.int64())], ["file", "n_ids"])

    def scan(batches):
        for batch in batches:
            for uri, block_no, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                fs, path = file_system(uri)
                first = block_no * block
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(width * min(block, size - first), width * first), f"<u{width}")
                ends = first + np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([block_no], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))], ["file", "block", "n_ids", "ends"])

    listed = files.select("file").distinct().repartition(n, "file").mapInArrow(sizes, "file string, n_ids long")
    blocks = listed.filter("n_ids > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block))).alias("block"), "n_ids")
    found = blocks.repartition(n, "file", "block").mapInArrow(scan, "file string, block long, n_ids long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # blocks of one file
    carried = found.select(
        "*",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0).cast("long")).alias("docs_before"),
        F.coalesce(F.max(F.element_at("ends", F.when(F.size("ends") > 0, -1).otherwise(F.lit(None)).cast("int"))).over(before), F.lit(-1).cast("long")).alias("end_before"),
    )
    last = (F.col("block") + 1) * block >= F.col("n_ids")
    own_last = F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(F.col("end_before"))
    closed = carried.withColumn("open", last & (own_last < F.col("n_ids") - 1)).withColumn("cuts", F.when(F.col("open"), F.array_append("ends", F.col("n_ids"))).otherwise(F.col("ends")))
    docs = closed.select("file", "docs_before", "end_before", "n_ids", "cuts", F.posexplode("cuts").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("end_before")).otherwise(F.get("cuts", F.col("k") - 1)) + 1
    return docs.select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("n_ids")).alias("ended"))


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 50256, width: int = 2, folder: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row, and file, doc_no and start, which tell where it lies: flat files are written, scanned, and the counts brought to the documents. The files are the caller's if a folder is given; else they lie in the shared folder until the application ends, as the counts are read from them."""
    spark = docs.sparkSession
    manifest = write_flat(docs, folder or fresh_path(spark, "flat"), name, end_id, width)
    counts = scan_flat(spark, manifest, end_id, width)
    return manifest.join(counts.hint("merge"), ["file", "doc_no"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), "file", "doc_no", "start")
