"""Token ids in files of separately compressed documents with one shared zstandard dictionary.

A file holds, in ascending order of doc_id: each document's ids as a little
array (16 bits wide where the vocabulary allows), compressed on its own; then
an index of (doc_id, byte offset, byte length, number of ids); then a JSON
foot with the SHA-256 of the dictionary, the width and the index's place.  One
document is read by its index entry alone.  The dictionary lies once beside
the files; it is trained on the id arrays of a bounded sample of documents
(``sample_docs`` of at most ``sample_chars`` each, those of smallest id hash),
which changes sizes only.

A task begins another file whenever one has reached ``file_bytes`` or
``file_docs``, which bounds the index that it holds in memory.  Files are
written under another name and moved when whole, so a task that is run again
leaves whole files of the same names.  Defined cases: a null text is empty and
has the end id alone; rows that repeat a doc_id are kept, ordered by checksum;
null ids come first; an empty table gives no document.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, table, tidy
from .subwords import encoder, slices, vocabulary

MAGIC = b"GLTOKENS1"
INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("at", "<u8"), ("size", "<u4"), ("n", "<u4")])


def file_system(folder: str):
    """(file system, path) of a folder's URI, as Arrow reaches it from the driver and the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def train_dictionary(arrays: list[bytes], size: int) -> bytes:
    """A dictionary from id arrays; empty where there is too little to train on."""
    import zstandard

    if sum(map(len, arrays)) < 16 * size or len(arrays) < 64:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class TokenFileWriter:
    def __init__(self, folder: str, name: str, dictionary: bytes, width: int, level: int = 3):
        import zstandard

        self.fs, base = file_system(folder)
        self.path = f"{base}/{name}"
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.index, self.width = len(MAGIC), [], width
        self.digest = hashlib.sha256(dictionary).hexdigest()
        shared = _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=level)  # else each document would load it anew
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=shared)

    def add(self, doc_id, ids: np.ndarray) -> None:
        blob = self.zstd.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(blob)
        self.index.append((doc_id or 0, doc_id is None, self.at, len(blob), len(ids)))
        self.at += len(blob)

    def close(self) -> None:
        index = np.array(self.index, INDEX).tobytes()
        foot = json.dumps({"dictionary": self.digest, "width": self.width, "index": self.at, "documents": len(self.index)}).encode()
        self.out.write(index + foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class TokenFileReader:
    """Reads any document of a file by its place in the index, or all of them in order."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        import zstandard

        self.fs, base = file_system(folder)
        self.file = self.fs.open_input_file(f"{base}/{name}")
        end = self.file.size()
        tail = self.file.read_at(4 + len(MAGIC), end - 4 - len(MAGIC))
        if tail[4:] != MAGIC:
            raise ValueError(f"{name} is not a whole token file")
        size = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self.file.read_at(size, end - 4 - len(MAGIC) - size))
        if self.foot["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{name} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(self.foot["documents"] * INDEX.itemsize, self.foot["index"]), INDEX)
        self.zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _decode(self, blob: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.zstd.decompress(blob, max_output_size=int(n) * self.foot["width"]), f"<u{self.foot['width']}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        e = self.index[k]
        return self._decode(self.file.read_at(int(e["size"]), int(e["at"])), e["n"])

    def documents(self, block: int = 8 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order; the file is read in blocks of about ``block`` bytes."""
        k = 0
        while k < len(self.index):
            first = int(self.index["at"][k])
            end = max(k + 1, int(np.searchsorted(self.index["at"], first + block)))
            last = self.index[end - 1]
            data = self.file.read_at(int(last["at"]) + int(last["size"]) - first, first)
            for e in self.index[k:end]:
                a = int(e["at"]) - first
                yield None if e["null_id"] else int(e["doc_id"]), self._decode(data[a : a + int(e["size"])], e["n"])
            k = end


FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 20


def _write(folder: str, path: str, end_id: int, dictionary: bytes, width: int, file_bytes: int, file_docs: int):
    """A row (name, documents, ids) for each file; the names' order is that of their documents."""

    def run(batches):
        part_id, subwords, writer, ids_in, done = TaskContext.get().partitionId(), encoder(path), None, 0, []

        def close():
            writer.close()
            done.append((name_of(), len(writer.index), ids_in))

        def name_of():
            return f"part-{part_id:06d}-{len(done):06d}.tok"

        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, offsets = subwords.encode(part.column("text"))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
                    writer = writer or TokenFileWriter(folder, name_of(), dictionary, width)
                    writer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
                    ids_in += int(b - a) + 1
                    if writer.at >= file_bytes or len(writer.index) >= file_docs:
                        close()
                        writer, ids_in = None, 0
        if writer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 3, (pa.string(), pa.int64(), pa.int64()))], ["name", "documents", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str, end_id=0, partitions=None, dictionary_bytes=65_536, sample_docs=1000, sample_chars=16_384, file_bytes=FILE_BYTES, file_docs=FILE_DOCS, id_col="doc_id", text_col="text") -> list[tuple[str, int, int]]:
    """Write all documents in ascending order of doc_id; returns (file, documents, ids) of each file in order."""
    spark = docs.sparkSession
    # As many ranges as the input has splits, so that a range does not grow with the input.
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = max(1, rows.count() // (2 * sample_docs))
    place = F.xxhash64("doc_id")
    sample = rows.where(F.pmod(place, F.lit(every)) == 0).select(place.alias("place"), "doc_id", F.substring("text", 1, sample_chars).alias("text"))
    sample = sample.orderBy("place", "doc_id", "text").limit(sample_docs).select("text").toArrow()["text"].combine_chunks()
    subwords = encoder(vocabulary_path)
    width = 2 if max(len(subwords.width) - 1, end_id) < 1 << 16 else 4
    ids, offsets = subwords.encode(sample if isinstance(sample, pa.Array) else pa.array([], pa.string()))
    dictionary = train_dictionary([ids[a:b].astype(f"<u{width}").tobytes() for a, b in zip(offsets[:-1], offsets[1:])], dictionary_bytes)
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary.zstd") as out:
        out.write(dictionary)
    crc = F.crc32(F.col("text").cast("binary"))
    ordered = rows.repartitionByRange(partitions, "doc_id", crc).sortWithinPartitions("doc_id", crc)
    files = ordered.mapInArrow(tidy(_write(folder, vocabulary_path, end_id, dictionary, width, file_bytes, file_docs)), "name string, documents long, ids long").collect()  # a row for each file
    files = sorted((r.name, r.documents, r.ids) for r in files)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "files": files}).encode())
    return files


def _read(folder: str):
    def run(batches):
        dictionary = None
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                if dictionary is None:
                    fs, base = file_system(folder)
                    with fs.open_input_file(f"{base}/dictionary.zstd") as f:
                        dictionary = f.read()
                cols: list[list] = [[], [], [], []]
                for doc, ids in TokenFileReader(folder, name, dictionary).documents():
                    for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(ids))):
                        c.append(v)
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    starts = np.concatenate([[0], np.cumsum([n for *_, n in files])]).tolist()
    rows = spark.createDataFrame([(name, s) for (name, *_), s in zip(files, starts)], "name string, start long")
    return rows.repartition(max(1, len(files))).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_query(spark, sf_dir) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return read_token_files(spark, folder)
