"""Token ids of a corpus in flat binary files that can be memory-mapped.

A folder holds, per partition in ascending document order, ``part-N.bin`` (ids
as little-endian unsigned integers), ``part-N.off`` (64-bit token offsets, one
more than documents) and ``part-N.doc`` (64-bit document ids), and one
``index.json`` with the id width and, per partition, the documents and tokens
before it: prefix sums over the partitions. A document's ids are then one slice
of one file, and its place in the whole corpus one addition.
"""

from __future__ import annotations

import json
import mmap
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from glasswork.llm.inputs import new_folder, slices, texts
from glasswork.llm.tokenizing import encoder

NULL_ID = -(2**63)
_READ_DOCS = 4096


def _store(folder: str):
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, path


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = 0,
                      id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> str:
    """Encode every whole text, append ``end_id``, write the files; returns the folder.

    Rows go by ``id_col`` ascending (nulls first), repeated ids by text. A null
    text is an empty one and holds only the end id. A task writes under a name
    of its own and renames at the end, so a repeated task leaves whole files.
    An empty table gives an index without partitions.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs, id_col, text_col).repartitionByRange(n, "_id").sortWithinPartitions("_id", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = b"" if end_id is None else encode.pack([end_id])
        store, top = _store(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        at, offsets, ids, out = 0, [np.zeros(1, "i8")], [], None
        for batch in batches:
            for some in slices(batch, "_text"):
                if out is None:
                    out = store.open_output_stream(f"{top}/.{part}-{attempt}.bin")
                raw = encode.encode(some["_text"], end)
                stops = np.frombuffer(raw.buffers()[1], "i8")
                out.write(raw.buffers()[2].slice(0, int(stops[-1])))
                offsets.append(at + stops[1:] // encode.width)
                at = int(offsets[-1][-1])
            ids += batch["_id"].fill_null(NULL_ID).to_pylist()
        if out is None:
            return
        out.close()
        for kind, values in (("off", np.concatenate(offsets)), ("doc", ids)):
            with store.open_output_stream(f"{top}/.{part}-{attempt}.{kind}") as f:
                f.write(np.array(values, "<i8").tobytes())
        for kind in ("bin", "off", "doc"):
            store.move(f"{top}/.{part}-{attempt}.{kind}", f"{top}/part-{part}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(ids)], "tokens": [at], "width": [encode.width]})

    # One row per partition reaches the driver.
    rows = sorted(ordered.mapInArrow(write, "part long, docs long, tokens long, width long").collect())
    docs_before = np.cumsum([0, *[r.docs for r in rows]]).tolist()
    tokens_before = np.cumsum([0, *[r.tokens for r in rows]]).tolist()
    index = {"width": rows[0].width if rows else 2, "docs": docs_before[-1], "tokens": tokens_before[-1], "parts": [
        {"part": r.part, "docs": r.docs, "tokens": r.tokens, "docs_before": d, "tokens_before": t}
        for r, d, t in zip(rows, docs_before, tokens_before)]}
    with fs.open_output_stream(f"{path}/index.json") as f:
        f.write(json.dumps(index).encode())
    return folder


def read_index(folder: str) -> dict:
    fs, path = _store(folder)
    with fs.open_input_stream(f"{path}/index.json") as f:
        return json.loads(f.read())


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a file system, read where it is not."""
    fs, path = _store(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.getsize(f"{path}/{name}") == 0:
            return np.zeros(0, dtype)
        with open(f"{path}/{name}", "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def document_ids(folder: str, number: int) -> tuple[int | None, np.ndarray]:
    """Document id and token ids of the ``number``-th document of the corpus (from 0)."""
    index = read_index(folder)
    part = next(p for p in reversed(index["parts"]) if p["docs_before"] <= number)
    k = number - part["docs_before"]
    offsets = mapped(folder, f"part-{part['part']}.off", "<i8")
    ids = mapped(folder, f"part-{part['part']}.bin", f"<u{index['width']}")
    doc = int(mapped(folder, f"part-{part['part']}.doc", "<i8")[k])
    return (None if doc == NULL_ID else doc), ids[offsets[k]: offsets[k + 1]]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from the files, one task per partition file."""
    index = read_index(folder)
    width = index["width"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    parts = [(p["part"], p["docs"], p["tokens_before"]) for p in index["parts"]]
    if not parts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)), "part long, docs long, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(folder, f"part-{row['part']}.bin", f"<u{width}")
                offsets = mapped(folder, f"part-{row['part']}.off", "<i8")
                names = mapped(folder, f"part-{row['part']}.doc", "<i8")
                for a in range(0, row["docs"], _READ_DOCS):
                    b = min(a + _READ_DOCS, row["docs"])
                    cut = offsets[a: b + 1]
                    crcs = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names[a:b], mask=names[a:b] == NULL_ID), pa.array(cut[:-1] + row["base"]),
                        pa.array(np.diff(cut)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, schema)
