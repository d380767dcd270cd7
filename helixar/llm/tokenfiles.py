"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets, read by memory mapping.

Documents are dealt by ranges of their id, so shard k holds the ids right before those of shard k + 1. A task encodes
its documents and streams three flat little-endian files: `tokens` (u2 or u4), `offsets` (u8, one more than documents,
counted from the shard's start) and `ids` (i8). The driver learns one row per shard and adds the shards' bases by
a prefix sum, kept in `manifest.json`. Files appear under their final name by an atomic rename, so a task that
runs twice writes the same file twice.

Cases: null text is empty (only the end id); null doc_id sorts first and reads back as null; repeated rows are kept,
ordered by (doc_id, text); an empty table gives a manifest without shards and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixar.llm import common, wordtok

#: Stands for a null doc_id in an `ids` file.
NO_ID = -(1 << 63)


class Files:
    """Whole files under one folder, local (memory-mapped) or in any store that pyarrow knows."""

    def __init__(self, root: str):
        url = urlparse(root)
        self.local = url.scheme in ("", "file")
        if self.local:
            from pyarrow import fs

            self.fs, self.root = fs.LocalFileSystem(), url.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)

    def mkdir(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def writer(self, name: str):
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def rename(self, old: str, new: str) -> None:
        self.fs.move(f"{self.root}/{old}", f"{self.root}/{new}")

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f:
            return f.read()

    def stream(self, name: str):
        return self.fs.open_input_stream(f"{self.root}/{name}", compression=None)

    def array(self, name: str, kind: str) -> np.ndarray:
        """The file as an array; mapped, not read, where the file is local."""
        if self.local:
            path = f"{self.root}/{name}"
            if not self.fs.get_file_info(path).size:
                return np.empty(0, kind)
            return np.memmap(path, dtype=kind, mode="r")
        return np.frombuffer(self.read(name), kind)


def write_token_files(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode `docs` into the files described above, in ascending id order; returns the manifest."""
    spark = docs.sparkSession
    kind = wordtok.id_type(tokenizer)
    Files(root).mkdir()

    def write(batches):
        from pyspark import TaskContext

        shard, files, enc = TaskContext.get().partitionId(), Files(root), wordtok.encoder(tokenizer)
        mark = uuid.uuid4().hex
        names = [f"{x}-{shard:06d}.bin" for x in ("tokens", "offsets", "ids")]
        out, n_docs, n_tokens = None, 0, 0
        for part in (x for batch in batches for x in wordtok.slices(batch, 1)):
            if out is None:
                out = [files.writer(f"{x}.{mark}") for x in names]
                out[1].write(np.zeros(1, "<u8").tobytes())
            ids, sizes = enc.encode(part.column(1), end_id)
            ends = n_tokens + np.cumsum(sizes)
            out[0].write(ids.astype(kind).tobytes())
            out[1].write(ends.astype("<u8").tobytes())
            out[2].write(np.asarray(part.column(0).fill_null(NO_ID), "<i8").tobytes())
            n_docs, n_tokens = n_docs + part.num_rows, int(ends[-1])
        if out is not None:
            for f, x in zip(out, names, strict=True):
                f.close()
                files.rename(f"{x}.{mark}", x)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    mix = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))  # row: equal rows may part
    shards = sorted(
        rows.repartitionByRange(common.partitions(spark), "id", mix, "row").sortWithinPartitions("id", mix, "text").drop("row").mapInArrow(write, "shard long, n_docs long, n_tokens long").collect()
    )
    manifest: dict = {"type": kind, "end_id": end_id, "shards": []}
    docs_before = tokens_before = 0
    for shard, n_docs, n_tokens in shards:
        manifest["shards"].append({"shard": shard, "n_docs": n_docs, "n_tokens": n_tokens, "first_doc": docs_before, "first_token": tokens_before})
        docs_before, tokens_before = docs_before + n_docs, tokens_before + n_tokens
    manifest |= {"n_docs": docs_before, "n_tokens": tokens_before}
    with Files(root).writer("manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class TokenFiles:
    """Random access to written files from one process: ids(k) maps one document's ids."""

    def __init__(self, root: str):
        self.files = Files(root)
        self.manifest = json.loads(self.files.read("manifest.json"))
        self.first = np.asarray([s["first_doc"] for s in self.manifest["shards"]], np.int64)

    def __len__(self) -> int:
        return self.manifest["n_docs"]

    def ids(self, k: int) -> np.ndarray:
        s = self.manifest["shards"][int(np.searchsorted(self.first, k, "right")) - 1]
        offsets = self.files.array(f"offsets-{s['shard']:06d}.bin", "<u8")
        a, b = offsets[k - s["first_doc"] : k - s["first_doc"] + 2]
        return self.files.array(f"tokens-{s['shard']:06d}.bin", self.manifest["type"])[int(a) : int(b)]


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. A task per shard."""
    manifest = json.loads(Files(root).read("manifest.json"))
    kind = manifest["type"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        files = Files(root)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, offsets, ids = (files.array(f"{x}-{shard:06d}.bin", t) for x, t in (("tokens", kind), ("offsets", "<u8"), ("ids", "<i8")))
                at = offsets.astype(np.int64)
                for i in range(0, len(ids), 4096):
                    cut = at[i : i + 4097]
                    part = np.asarray(tokens[cut[0] : cut[-1]]).astype("<u4")
                    local = cut - cut[0]
                    crc = [zlib.crc32(part[a:b]) for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
                    own = np.asarray(ids[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(s["shard"], s["first_token"]) for s in manifest["shards"]]
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, "shard long, base long").repartition(len(rows)).mapInArrow(read, schema)
