"""Token ids in a fixed-width bit-packed file format with random access.

File: ``KSIDS002``, then per block of ``BLOCK_IDS`` ids the packed bits (little-endian bit
order, padded to a byte), then a footer: document ids (int64), ids in each document
(int64), byte offset of each block (int64), and a fixed tail of seven int64 (width in bits,
documents, how many of them, the first ones, have a null id, ids, blocks, offset of the footer,
CRC-32 of the footer and these six) and the magic again.
The width is the least that holds every id of the vocabulary.  Id k lies in block
k // BLOCK_IDS at bit (k % BLOCK_IDS) * width, so any range is read with one seek.

Files are written by the executors through ``pyarrow.fs`` into the shared folder, each
under a name of its own attempt; readers open only the names that the successful
attempts returned, so lost or repeated tasks leave no wrong data behind.

Encoding runs the tokenizer once for every distinct piece of text that a worker meets: the
tokenizer never joins anything across white space, nor across a border between an ASCII
letter and ASCII punctuation other than an apostrophe, so the ids of a text are those of its
pieces in a row.  Texts that hold one of the tokenizer's added tokens go through it whole.

Null and empty texts have the end id only.  Equal doc_ids stay side by side, in the order
of a hash of their texts; null doc_ids come first.  Ranges are cut by doc_id and that hash, so
one doc_id of many texts, or none, spreads over tasks.  A text has no greatest length; a worker
holds a text and its ids at once.  Other columns are ignored; an empty table has no files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch
from .textops import _BASE, _CODE, _INVERSE, CHUNK, SPACE, _cuts, _power, buffers, mix, slices

MAGIC = b"KSIDS002"
BLOCK_IDS = 1 << 16
END_ID = 1
KEPT_PIECES = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _PUNCT[_a:_b] = True
_PUNCT[39] = False
_KIND = (_LETTER * 1 + _PUNCT * 2).astype(np.uint8)


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in width bits each, least significant bit first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = ((ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int, first_bit: int = 0) -> np.ndarray:
    """count ids from a bit position on."""
    if width == 16 and first_bit % 16 == 0:
        return np.frombuffer(data, "<u2", count, first_bit // 8).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[first_bit : first_bit + count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class IdWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, len(MAGIC)
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.blocks: list[int] = []
        self.rest = np.zeros(0, np.uint32)
        self.ids = 0
        self.nulls = 0
        stream.write(MAGIC)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, nulls: int = 0) -> None:
        """nulls: how many of the documents, the first ones, have no id; the file has none with an id before them."""
        self.nulls += nulls
        self.docs.append(doc_ids.astype(np.int64))
        self.sizes.append(sizes.astype(np.int64))
        self.ids += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        full = len(self.rest) // BLOCK_IDS * BLOCK_IDS
        for k in range(0, full, BLOCK_IDS):
            self._block(self.rest[k : k + BLOCK_IDS])
        self.rest = self.rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.blocks.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        none = [np.zeros(0, np.int64)]
        docs, sizes = np.concatenate(self.docs or none), np.concatenate(self.sizes or none)
        footer = docs.tobytes() + sizes.tobytes() + np.array(self.blocks, np.int64).tobytes()
        tail = np.array([self.width, len(docs), self.nulls, self.ids, len(self.blocks), self.at], np.int64).tobytes()
        self.stream.write(footer + tail + np.int64(zlib.crc32(footer + tail)).tobytes() + MAGIC)
        self.stream.close()


class IdReader:
    """Random access to one file: an object with seek and read."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - 64)
        tail = stream.read(64)
        if tail[56:] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.width, n, self.nulls, self.n_ids, blocks, at, crc = (int(x) for x in np.frombuffer(tail[:56], np.int64))
        stream.seek(at)
        footer = stream.read(16 * n + 8 * blocks)
        if zlib.crc32(footer + tail[:48]) != crc:
            raise ValueError("the footer of a file of packed ids is damaged")
        self.doc_ids = np.frombuffer(footer, np.int64, n)
        self.sizes = np.frombuffer(footer, np.int64, n, 8 * n)
        self.blocks = np.frombuffer(footer, np.int64, blocks, 16 * n)
        self.end = at
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count - 1, reading only the bytes that hold them."""
        out = [np.zeros(0, np.uint32)]
        while count > 0:
            b, k = divmod(start, BLOCK_IDS)
            take = min(count, BLOCK_IDS - k)
            first = k * self.width
            self.stream.seek(int(self.blocks[b]) + first // 8)
            data = self.stream.read((first % 8 + take * self.width + 7) // 8)
            out.append(unpack(data, take, self.width, first % 8))
            start, count = start + take, count - take
        return np.concatenate(out)

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.starts[row]), int(self.sizes[row]))


class PieceEncoder:
    """A tokenizer with the ids of pieces that it has met, as arrays; bounded by KEPT_PIECES."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.slot = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        self.at = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], hashes: np.ndarray) -> None:
        """Encode new pieces.  Those of letters only end in the one id that ends a word, so they go in long rows."""
        plain = np.array([p.isalpha() for p in pieces], bool)
        lists: list = [None] * len(pieces)
        easy = np.flatnonzero(plain)
        for k in range(0, len(easy), 2000):
            own = easy[k : k + 2000]
            ids = np.array(self._whole([" ".join([pieces[i] for i in own])])[0], self.flat.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(own):
                for i, part in zip(own, np.split(ids, cut[:-1])):
                    lists[i] = part
            else:
                for i, part in zip(own, self._whole([pieces[i] for i in own])):
                    lists[i] = np.array(part, self.flat.dtype)
        hard = np.flatnonzero(~plain)
        for i, part in zip(hard, self._whole([pieces[i] for i in hard])):
            lists[i] = np.array(part, self.flat.dtype)
        base = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in lists])])
        self.flat = np.concatenate([self.flat, *lists])
        known, slot = np.concatenate([self.known, hashes]), np.concatenate([self.slot, base + np.arange(len(pieces))])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has (without end ids)."""
        data, offsets = buffers(texts)
        if self.added and any(data.tobytes().find(t) >= 0 for t in self.added):
            lists = self._whole([t or "" for t in texts.to_pylist()])
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        hashes, starts, stops = _pieces(data, offsets)
        owner = np.searchsorted(starts, offsets)
        new, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(new) > KEPT_PIECES:
            self.clear()
        at = np.searchsorted(self.known, new)
        unknown = np.ones(len(new), bool)
        inside = at < len(self.known)
        unknown[inside] = self.known[at[inside]] != new[inside]
        if unknown.any():
            raw = data.tobytes()
            own = first[unknown]
            self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[own].tolist(), stops[own].tolist())], new[unknown])
            at = np.searchsorted(self.known, new)
        slot = self.slot[at][back] if len(new) else np.zeros(0, np.int64)
        length = self.at[slot + 1] - self.at[slot]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[slot] - (ends - length), length) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[owner]
        return ids, np.diff(bounds)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and past-the-last byte of every piece."""
    hashes, first, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = _cuts(data, offsets, CHUNK)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        part = data[a:b]
        solid, kind = ~SPACE[part], _KIND[part]
        split = np.ones(len(part) + 1, bool)  # a border before byte i
        split[1:-1] = (solid[1:] != solid[:-1]) | (kind[1:] + kind[:-1] == 3)
        split[offsets[(offsets > a) & (offsets < b)] - a] = True
        border = np.flatnonzero(split)
        s, e = border[:-1], border[1:]
        own = solid[s]
        s, e = s[own], e[own]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * _power("up", int(_BASE), len(part))[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * _power("down", _INVERSE, len(part))[s] + (e - s).astype(np.uint64)))
        first.append(s + a)
        last.append(e + a)
    return np.concatenate(hashes), np.concatenate(first), np.concatenate(last)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process: what it has met serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer, name = None, None, None
        coder = encoder(tokenizer)
        width = width_of(max(coder.tokenizer.get_vocab_size(), end_id + 1))
        low = None
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    files, path = _filesystem(folder)
                    files.create_dir(path, recursive=True)
                    name = f"ids-{uuid.uuid4().hex}.bin"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    writer = IdWriter(out, width)
                ids, sizes = coder.encode(part.column("text"))
                ends = np.cumsum(sizes)
                ids = np.insert(ids.astype(np.uint32), ends, end_id)
                docs = part.column("doc_id")
                low = (docs[0].as_py(), part.column("h")[0].as_py()) if low is None else low
                writer.add(docs.fill_null(0).to_numpy(zero_copy_only=False), sizes + 1, ids, docs.null_count)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (*low, writer.ids))], ["name", "low", "low_hash", "ids"])

    return run


def write_token_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write every text in ascending doc_id order; one row for each file: name, low and low_hash (first doc_id, hash of its text), ids."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = texts.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return ordered.mapInArrow(_write(folder, tokenizer, end_id), "name string, low long, low_hash long, ids long")


def read_token_ids(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files named with their base (ids before them)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _filesystem(folder)
        for f in frames:
            for name, base in zip(f["name"], f["base"]):
                with store.open_input_file(f"{path}/{name}") as stream:
                    reader = IdReader(stream)
                    at = 0
                    while at < len(reader.sizes):  # about a million ids at a time
                        to = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + (1 << 20), "right")) - 1)
                        ids = reader.ids(int(reader.starts[at]), int(reader.starts[to] - reader.starts[at])).astype("<u4")
                        cut = reader.starts[at : to + 1] - reader.starts[at]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])]
                        doc = pd.array(reader.doc_ids[at:to], dtype="Int64")
                        doc[: max(0, reader.nulls - at)] = pd.NA
                        yield pd.DataFrame({"doc_id": doc, "start": base + reader.starts[at:to], "n_tokens": reader.sizes[at:to], "ids_crc32": crc})
                        at = to

    return files.select("name", "base").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "token-ids")
    folder = f"{scratch.path}/files"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = scratch.table(write_token_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json")), "written")
    # One row for each file: as many as there are partitions, whatever the documents.
    rows = sorted(written.collect(), key=lambda r: (r["low"] is not None, r["low"] or 0, r["low_hash"]))
    base, listed = 0, []
    for r in rows:
        listed.append((r["name"], base))
        base += r["ids"]
    files = spark.createDataFrame(listed, "name string, base long").repartition(max(1, len(listed)))
    return read_token_ids(files, folder)
