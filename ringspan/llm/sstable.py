"""Token ids in sorted-string-table shards, keyed by document id.

A shard holds the documents of one range of ids in ascending order. Layout, all integers little-endian:

* blocks of about 64 kB before compression (zstd). An entry is: shared key bytes, new key bytes, value bytes (three
  varints), the new part of the key, the value. Keys are 9 bytes: 0 for a null id, or 1 and the id's 64 bits,
  big-endian with the sign bit flipped, so that byte order is id order. Values are ids of 2 or 4 bytes.
* a sparse index: for each block first key (9), offset (8), length (4), CRC-32 (4), tokens before it in the file (8);
* a Bloom filter over the keys, ten bits a key, seven probes;
* a footer of fixed size: offsets and lengths of index and filter, entries, tokens, id width, magic.

Writing: one range shuffle of (id, text); each task encodes and writes its shard under a draft name and renames it,
so a lost or repeated task leaves whole files only. The driver sees one manifest row a shard.

Edge cases: a null text counts as empty (its document is the end id alone); a null id sorts first; repeated ids are
all kept, ordered by the text's hash, and may span shards; extra columns are ignored; an empty table writes no shard with entries and reads back
as an empty table. Texts are encoded whole.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import vocabulary
from .common import filesystem, fresh, put_file, small_batches, table, tidy
from .pretokens import splitter

MAGIC = b"RSSTAB01"
FOOTER = struct.Struct("<QQQQQQI8s")
INDEX = struct.Struct("<9sQIIQ")
BLOCK_BYTES = 64 << 10
BITS_A_KEY, PROBES = 10, 7
END_ID = 1
MEMO_WORDS = 400_000


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


class Writer:
    """chunks(entries): the bytes of a shard for (doc_id, ids) in ascending order of id."""

    def __init__(self, width: int):
        self.width, self.entries, self.tokens, self.first, self.last = width, 0, 0, None, None

    def chunks(self, entries):
        import zstandard

        pack, index, keys, offset = zstandard.ZstdCompressor(level=1), [], [], 0
        block, block_first, block_tokens, previous = bytearray(), b"", 0, b""

        def ended():
            raw = pack.compress(bytes(block))
            index.append(INDEX.pack(block_first, offset, len(raw), zlib.crc32(raw), block_tokens))
            return raw

        for doc_id, value in entries:
            key = key_of(doc_id)
            if len(block) >= BLOCK_BYTES:
                yield (raw := ended())
                offset += len(raw)
                block.clear()
            if not block:
                block_first, block_tokens, previous = key, self.tokens, b""
            shared = 0
            while shared < len(previous) and previous[shared] == key[shared]:
                shared += 1
            block += varint(shared) + varint(9 - shared) + varint(len(value)) + key[shared:]
            block += value
            if key != self.last:
                keys.append(key)
            self.first, self.last, previous = self.first or key, key, key
            self.entries += 1
            self.tokens += len(value) // self.width
        if block:
            yield (raw := ended())
            offset += len(raw)
        bits = max(64, BITS_A_KEY * len(keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        yield b"".join(index)
        yield bloom.tobytes()
        yield FOOTER.pack(offset, len(index) * INDEX.size, offset + len(index) * INDEX.size, bits, self.entries, self.tokens, self.width, MAGIC)


class Reader:
    """A shard, read by ranges: footer, index and filter once, then single blocks."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        tail = self._range(self.file.size() - FOOTER.size, FOOTER.size)
        at, length, bloom_at, self.bits, self.entries, self.tokens, self.width, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        raw = self._range(at, length)
        self.index = [INDEX.unpack_from(raw, i) for i in range(0, length, INDEX.size)]
        self.firsts = [x[0] for x in self.index]
        self.bloom = self._range(bloom_at, (self.bits + 7) // 8)
        self.kind = {2: "<u2", 4: "<u4"}[self.width]

    def _range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _block(self, i: int):
        """(doc_id, start in the file, ids) of one block."""
        import zstandard

        _, at, length, crc, start = self.index[i]
        raw = self._range(at, length)
        if zlib.crc32(raw) != crc:
            raise ValueError("a block is damaged")
        raw, at, key = zstandard.ZstdDecompressor().decompress(raw), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            new, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + new]
            at += new
            ids = np.frombuffer(raw, self.kind, size // self.width, at)
            at += size
            yield id_of(key), start, ids
            start += len(ids)

    def scan(self):
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents with this id: filter, binary search in the index, then the blocks that may hold it."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.index) and self.firsts[i] <= key:
            found += [ids for other, _, ids in self._block(i) if other == doc_id]
            i += 1
        return found


class _Memo(dict):
    """Bytes of a pre-token's ids, encoded at its first sight in a worker."""

    def __init__(self, path: str, kind: str):
        self.split, self.kind = splitter(path), kind

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = array(self.kind, self.split.encode(word)).tobytes()
        return out


MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint, bytes bigint, first_key binary, last_key binary"


def _write(path: str, folder: str, width: int, end_id: int):
    def run(batches):
        memo = _Memo(path, {2: "H", 4: "I"}[width])
        words, end = memo.split.words, end_id.to_bytes(width, "little")

        def entries():
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    yield doc_id, b"".join(map(memo.__getitem__, words(text.as_py() or ""))) + end

        writer, shard = Writer(width), TaskContext.get().partitionId()
        size = put_file(uri := f"{folder}/{shard:06d}.sst", writer.chunks(entries()))
        row = [[shard], [uri], [writer.entries], [writer.tokens], [size], [writer.first], [writer.last]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "path", "n_docs", "n_tokens", "bytes", "first_key", "last_key"])

    return run


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> list:
    """Encodes and writes all documents; the manifest, a row a shard in ascending order of ids."""
    from tokenizers import Tokenizer

    small_batches(docs.sparkSession)
    path = path or vocabulary("word_bpe_49k.json")
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    # by the text's hash as well, so that one id (or null) on very many rows is split; the bounds that Spark draws stay small
    ranged = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text", "xxhash64(text) AS _h").repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return sorted(r for r in ranged.mapInArrow(tidy(_write(path, folder, width, end_id)), MANIFEST).collect() if r["n_docs"])


def _read(batches):
    for batch in batches:
        for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            held = []
            for doc_id, start, ids in Reader(uri).scan():
                held.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32, from the files."""
    rows, base = [], 0
    for r in manifest:
        rows.append((r["path"], base))
        base += r["n_tokens"]
    files = spark.createDataFrame(rows, "path string, base bigint")
    if rows:
        files = files.repartition(len(rows))
    return files.mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """Ids of the documents with this id: binary search over the shards, of which several may hold it, then within each."""
    key, found = key_of(doc_id), []
    at = bisect.bisect_left([r["last_key"] for r in manifest], key)
    while at < len(manifest) and manifest[at]["first_key"] <= key:
        found += Reader(manifest[at]["path"]).get(doc_id)
        at += 1
    return found


def op5_sstable(spark, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(table(spark, sf_dir, "documents"), fresh(spark, "sstable")))
