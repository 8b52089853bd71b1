"""Token ids in binary files, each id in as few bits as the vocabulary needs.

A shard file holds whole documents in ascending order:

* header, 64 bytes: magic ``b"PFTOKEN1"``, then little-endian unsigned 64-bit
  integers: bits an id, tokens a block, documents, tokens, blocks, and 0 twice;
* the documents' ids, signed 64 bits each (the least value stands for null);
* the documents' token offsets in the shard, unsigned 64 bits, one more than documents;
* the blocks' byte offsets in the payload, unsigned 64 bits, one more than blocks;
* payload: blocks of ids as one string of bits, the least significant first; each
  block starts at a byte.

A reader can fetch any token range from the offsets and unpack its blocks with
numpy. A shard is written under a name of its attempt and then renamed, so a
repeated or lost task leaves no half file under a final name; the list of shards
is a table that Spark commits.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purseflow.llm.bpe import WordBpe, read_spec
from purseflow.storage import materialize, new_path

MAGIC = b"PFTOKEN1"
BLOCK = 4096
SHARD_TOKENS = 4_000_000
NULL_ID = -(1 << 63)


def bits_needed(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.asarray(ids, "<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    as_bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(as_bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    as_bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = as_bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """A shard of documents whose ids are little-endian unsigned 32-bit integers."""
    n = np.array([len(x) // 4 for x in ids], np.uint64)
    tokens = np.frombuffer(b"".join(ids), "<u4")
    blocks = [pack(tokens[at : at + block], bits) for at in range(0, len(tokens), block)]
    offsets = np.r_[0, np.cumsum([len(x) for x in blocks])].astype("<u8")
    head = MAGIC + struct.pack("<7Q", bits, block, len(doc_ids), len(tokens), len(blocks), 0, 0)
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, keys.tobytes(), np.r_[np.uint64(0), np.cumsum(n, dtype=np.uint64)].astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Random access to a shard's bytes; blocks are unpacked as they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block, docs, self.n_tokens, blocks, _, _ = struct.unpack("<7Q", data[8:64])
        at = 64
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.doc_at = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.block_at = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def tokens(self, start: int, end: int) -> np.ndarray:
        first, last = start // self.block, -(-end // self.block)
        parts = []
        for b in range(first, last):
            n = min(self.block, self.n_tokens - b * self.block)
            parts.append(unpack(self.payload[self.block_at[b] : self.block_at[b + 1]], n, self.bits))
        whole = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return whole[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.doc_at[k]), int(self.doc_at[k + 1]))


class LibraryBpe(WordBpe):
    """As the tokenizers library encodes: its model gets each piece that is new to a
    worker, as this kind of tokenizer encodes pieces independently."""

    limit = 300_000

    def __init__(self, spec: str):
        super().__init__(spec)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.printable = {b: c for c, b in self.as_byte.items()}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        tokenize, out = self.library.model.tokenize, []
        for p in pieces:
            if not (p.isascii() and p.isprintable()):
                p = p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.printable)
            out.append(array("I", [t.id for t in tokenize(p)]).tobytes())
        return out


@lru_cache(maxsize=4)
def _model(spec: str) -> LibraryBpe:
    return LibraryBpe(spec)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _save(uri: str, data: bytes) -> None:
    store, path = _filesystem(uri)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, path)


def _write(spec, folder: str, end_id: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        bpe = _model(spec.value)
        bits = bits_needed(bpe.size)
        end = int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        seq, docs, ids, size = 0, [], [], 0

        def close():
            name = f"{part:08d}-{seq:06d}.tok"
            _save(f"{folder}/{name}", shard_bytes(docs, ids, bits))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([size], pa.int64())], names=["shard", "part", "seq", "n_docs", "n_tokens"])

        for b in batches:
            for doc, x in zip(b.column("doc_id").to_pylist(), bpe.encode_batch(b.column("text").to_pylist())):
                docs.append(doc)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= shard_tokens:
                    yield close()
                    seq, docs, ids, size = seq + 1, [], [], 0
        if docs:
            yield close()

    return run


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text, append ``end_id``, and write shards to ``folder`` in ascending
    order of doc_id (nulls first; repeated ids by text). Returns the table of shards
    (shard, part, seq, n_docs, n_tokens, start): start counts the tokens of all shards
    before. Null texts count as empty. The work is dealt by ranges of (doc_id, hash of
    the text), so repeated ids are split; a shard ends with the document that reaches
    ``shard_tokens``."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = materialize(dealt.mapInArrow(_write(spec, folder, end_id, shard_tokens), "shard string, part long, seq long, n_docs long, n_tokens long"), "shards")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))  # a row for each task that wrote
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return shards.withColumn("inside", inside).join(before, "part").select("shard", "part", "seq", "n_docs", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def _digest(batches):
    for b in batches:
        for data, start in zip(b.column("content"), b.column("start").to_pylist()):
            shard = Shard(data.as_py())
            whole = shard.tokens(0, shard.n_tokens).tobytes()
            crc = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(shard.doc_at[:-1].tolist(), shard.doc_at[1:].tolist())]
            ids = pa.array([None if d == NULL_ID else d for d in shard.doc_ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard.doc_at[:-1] + start), pa.array(np.diff(shard.doc_at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _with_content(shards: DataFrame, folder: str) -> DataFrame:
    files = shards.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").join(shards.select("shard", "start"), "shard")


def read_digests(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards, from the files."""
    return _with_content(shards, folder).select("content", "start").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches):
    for b in batches:
        for data in b.column("content"):
            shard = Shard(data.as_py())
            for k in range(len(shard.doc_ids)):
                d = int(shard.doc_ids[k])
                yield pa.RecordBatch.from_arrays([pa.array([None if d == NULL_ID else d], pa.int64()), pa.array([shard.document(k).astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def read_ids(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids array<int>) of each document in the shards."""
    return _with_content(shards, folder).select("content").mapInArrow(_ids, "doc_id long, ids array<int>")


def write_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all texts as shards into the shared folder and return what the files say
    of each document. An empty table writes no shard and returns no row."""
    folder = new_path(docs.sparkSession, "tokens")
    shards = write(docs, path, folder, end_id)
    if shards.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_digests(shards, folder)
