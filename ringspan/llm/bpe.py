"""BPE encoding and decoding through a distinct-word table.

1. Texts are read once and split into pre-tokens. Each chunk of text (some 12 million characters of one input split)
   numbers its distinct words by falling count, lists them dealt into buckets by a hash of the word: (chunk, bucket,
   words), and keeps every text as the positions of its words, in a file a task, of which the table names the chunk's
   range. Table and files lie in the shared folder, so later steps don't depend on how the input is split or planned.
2. The lists go to their buckets; there each distinct word is encoded once, and each list goes back as the ids of its
   words in the list's order.
3. Where the ids of a chunk meet, its texts are read by range and ids are joined back by position. Only lists of distinct
   words and their ids are shuffled; nothing is collected or broadcast.
4. Decoding joins the distinct ids of a chunk with the vocabulary's id-to-piece table and lays the pieces by position.

Lists and positions are compressed, so that what moves is less than the texts. A worker holds the distinct words of one
bucket (at most 1,000,000 at a time, above which it starts again) or the words of one chunk.

Edge cases: a null text counts as empty and has no ids; texts that hold a special token's string encode it as the
library does; repeated or null ``doc_id`` each keep their row; extra columns are ignored; an empty table gives an empty
table. Long texts are encoded whole, as a chunk of their own; a batch of results is cut at about 8 MB. An id outside the
vocabulary decodes to nothing, as in the library.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Draft, filesystem, fresh, shuffle_partitions, small_batches, table, tidy, written
from .pretokens import pieces, splitter

#: Characters of text after which a chunk ends, words of a page of texts, words a worker remembers.
CHUNK_CHARS, PAGE_WORDS, MEMO_WORDS = 12_000_000, 16_384, 1_000_000
BATCH_BYTES = 8 << 20
LISTED = "chunk bigint, part int, file string, start bigint, payload binary"
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
_NAMES = ["chunk", "part", "file", "start", "payload"]
#: A chunk's texts in a file: positions of the listed words first, with neither ids nor counts, then pages of texts.
PAGES = pa.schema([("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary())])


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes, which compress better."""
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def pack(lengths: list[int] | np.ndarray, body: bytes) -> bytes:
    """Lengths of items and all their bytes, compressed."""
    return zstandard.ZstdCompressor(1).compress(len(lengths).to_bytes(4, "little") + _planes(np.asarray(lengths, np.uint32)) + body)


def unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    at = 4 + 4 * int.from_bytes(raw[:4], "little")
    return _numbers(raw[4:at]).astype(np.int64), raw[at:]


def words_in(packed: bytes) -> list[bytes]:
    lengths, raw = unpack(packed)
    ends = np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack_ids(items: list[bytes]) -> bytes:
    return pack([len(x) // 4 for x in items], _planes(np.frombuffer(b"".join(items), "<u4")))


def pack_numbers(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(_planes(numbers))


def unpack_numbers(packed: bytes) -> np.ndarray:
    return _numbers(zstandard.ZstdDecompressor().decompress(packed))


class Places(dict):
    """The place of each word in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _split(path: str, buckets: int, folder: str):
    def run(batches):
        words, task = splitter(path).words, TaskContext.get().partitionId()
        base, uri, out = task << 32, f"{folder}/{task:06d}-{uuid.uuid4().hex}.texts", None
        places, held, chars, chunk = Places(), [], 0, 0

        def flush():
            nonlocal out
            every = np.concatenate([p for _, p in held])
            # positions by falling count: small numbers are the most common
            by_count = np.argsort(-np.bincount(every, minlength=len(places)), kind="stable")
            position = np.empty(len(places), np.uint32)
            position[by_count] = np.arange(len(places))
            listed = [w.encode() for w in places]
            bucket = np.array([zlib.crc32(w) % buckets for w in listed], np.int64)
            order = np.lexsort((position, bucket))
            ends = np.searchsorted(bucket[order], np.arange(buckets), "right").tolist()
            rows = []
            for b, (a, e) in enumerate(zip([0, *ends], ends, strict=False)):
                if e > a:
                    part = [listed[i] for i in order[a:e].tolist()]
                    rows.append((base + chunk, b, None, None, pack(list(map(len, part)), b"".join(part))))
            pages, at = [(None, None, pack_numbers(np.diff(position[order], prepend=np.uint32(0))))], 0
            while at < len(held):
                end, n = at, 0
                while end < len(held) and (end == at or n + len(held[end][1]) <= PAGE_WORDS):
                    n += len(held[end][1])
                    end += 1
                page = held[at:end]
                pages.append(([d for d, _ in page], [len(p) for _, p in page], pack_numbers(position[np.concatenate([p for _, p in page])])))
                at = end
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PAGES) as stream:
                for page in pages:
                    stream.write_batch(pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(page, PAGES, strict=True)], schema=PAGES))
            out = out or Draft(uri)
            start, size = out.write(sink.getvalue().to_pybytes())
            rows.append((base + chunk, buckets, uri, start, size.to_bytes(8, "little")))
            yield from _cut(_NAMES, _KINDS, rows)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                found = words(text)
                held.append((doc_id, np.fromiter(map(places.__getitem__, found), np.uint32, len(found))))
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield from flush()
                    places, held, chars, chunk = Places(), [], 0, chunk + 1
        if held:
            yield from flush()
        if out:
            out.close()

    return run


def _cut(names: list[str], kinds: list[pa.DataType], rows):
    """Record batches of rows whose last column is bytes or text, cut by size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


class Encoded(dict):
    """Ids (little-endian unsigned 32-bit) of the words of a bucket, each encoded at its first sight."""

    def __init__(self, path: str):
        self.encode = splitter(path).encode

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = ids = array("I", self.encode(word.decode())).tobytes()
        return ids


def _encode_lists(path: str):
    def run(batches):
        known = Encoded(path)
        for batch in batches:
            packed = [pack_ids(list(map(known.__getitem__, words_in(p)))) for p in batch.column("payload").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(packed, pa.binary()))

    return run


def _table(path: str):
    def run(batches):
        encode, seen = splitter(path).encode, set()
        for batch in batches:
            fresh_ = {w for p in batch.column("payload").to_pylist() for w in words_in(p)} - seen
            seen |= fresh_
            rows = [(w.decode(), array("I", encode(w.decode())).tobytes()) for w in sorted(fresh_)]
            yield from _cut(["word", "ids"], [pa.string(), pa.binary()], rows)

    return run


class Pieces:
    """The id-to-piece table of a byte-level vocabulary; ``of`` joins it with ids."""

    def __init__(self, path: str):
        self.table = pa.table({"id": pa.array(range(len(found := pieces(path))), pa.uint32()), "piece": pa.array(found, pa.binary())})

    def of(self, ids: np.ndarray) -> dict[int, bytes]:
        distinct = pa.table({"id": pa.array(np.unique(ids), pa.uint32())})
        joined = distinct.join(self.table, "id", join_type="inner", use_threads=False)
        return dict(zip(joined["id"].to_pylist(), joined["piece"].to_pylist(), strict=True))


def _text(piece_of: dict[int, bytes], ids: np.ndarray) -> str:
    return b"".join([piece_of.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


class Chunk:
    """The ids of a chunk's words by position: its lists in order of buckets, and the positions of their words."""

    def __init__(self, lists: list[bytes], positions: bytes, vocabulary_: Pieces | None):
        found, at = [unpack(p) for p in lists], np.cumsum(unpack_numbers(positions), dtype=np.uint32)
        lengths = np.concatenate([n for n, _ in found]) if found else np.zeros(0, np.int64)
        self.ids = np.concatenate([_numbers(raw) for _, raw in found]) if found else np.zeros(0, "<u4")
        self.lengths, self.starts = np.empty_like(lengths), np.empty_like(lengths)
        self.lengths[at], self.starts[at] = lengths, np.cumsum(lengths) - lengths
        self.pieces = vocabulary_.of(self.ids) if vocabulary_ else None

    def texts(self, doc_ids: list, counts: list[int], positions: np.ndarray):
        """(doc_id, ids) of the texts of one page."""
        n = self.lengths[positions]
        ends = np.concatenate(([0], np.cumsum(n)))
        every = self.ids[np.repeat(self.starts[positions] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
        for k, doc_id in enumerate(doc_ids):
            yield doc_id, every[bounds[k] : bounds[k + 1]]


def texts_of(file: str, start: int, size: int):
    """(doc_ids, counts, positions) of a chunk's pages."""
    store, path = filesystem(file)
    with store.open_input_file(path) as held:
        raw = held.read_at(size, start)
    for batch in pa.ipc.open_stream(pa.py_buffer(raw)):
        yield tuple(column[0].as_py() for column in batch.columns)


def _lay(path: str, buckets: int, decoded: bool):
    """Of rows sorted by chunk and part: lists of ids first, then where the chunk's texts are."""

    def run(batches):
        vocabulary_ = Pieces(path) if decoded else None

        def rows():
            now, lists = None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    chunk, part, file, start, payload = (batch.column(c)[i].as_py() for c in _NAMES)
                    if chunk != now:
                        now, lists = chunk, []
                    if part < buckets:
                        lists.append(payload)
                        continue
                    pages = texts_of(file, start, int.from_bytes(payload, "little"))
                    words = Chunk(lists, next(pages)[2], vocabulary_)
                    for doc_ids, counts, positions in pages:
                        for doc_id, ids in words.texts(doc_ids, counts, unpack_numbers(positions)):
                            yield (doc_id, ids.tobytes(), _text(words.pieces, ids)) if decoded else (doc_id, ids.tobytes())

        yield from _cut(["doc_id", "ids", "decoded"][: 2 + decoded], [pa.int64(), pa.binary(), pa.string()][: 2 + decoded], rows())

    return run


def listed(docs: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(the table of lists and of where the texts are, the number of buckets). The only pass over the texts."""
    small_batches(docs.sparkSession)
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(slim.mapInArrow(tidy(_split(path, buckets, fresh(docs.sparkSession, "bpe-texts"))), LISTED), "bpe-listed"), buckets


def by_bucket(lists: DataFrame, buckets: int) -> DataFrame:
    return lists.filter(F.col("part") < buckets).repartition(buckets // 2, "part")


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """word, ids (unsigned 32-bit little-endian): the distinct-word table."""
    found, buckets = listed(docs, path)
    return by_bucket(found, buckets).select("payload").mapInArrow(tidy(_table(path)), "word string, ids binary")


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: unsigned 32-bit little-endian); with ``decoded``, also the text that :func:`decode` makes of
    them, in the same pass."""
    found, buckets = listed(docs, path)
    ids = by_bucket(found, buckets).mapInArrow(tidy(_encode_lists(path)), LISTED)
    texts = found.filter(F.col("part") == buckets)
    parts = max(buckets // 2, texts.count() // 2)  # some two chunks a task
    both = ids.union(texts).repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    return both.mapInArrow(tidy(_lay(path, buckets, decoded)), "doc_id bigint, ids binary" + ", decoded string" * decoded)


def _decode(path: str):
    def run(batches):
        vocabulary_ = Pieces(path)
        for batch in batches:
            found = [np.frombuffer(ids or b"", "<u4") for ids in batch.column("ids").to_pylist()]
            piece_of = vocabulary_.of(np.concatenate(found)) if found else {}
            rows = zip(batch.column("doc_id").to_pylist(), [ids.tobytes() for ids in found], [_text(piece_of, ids) for ids in found], strict=True)
            yield from _cut(["doc_id", "ids", "decoded"], [pa.int64(), pa.binary(), pa.string()], rows)

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to doc_id and ids: the distinct ids of a batch joined with the id-to-piece table."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decode(path)), "doc_id bigint, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, path or vocabulary("byte_bpe_50k.json"), decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
