"""WARC archives with a two-level capture index.

Archives: gzip members, one for each record, written by the executors into the shared folder.
Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest
page_id is a response, the others revisit it and carry no payload; smaller ones are all
responses.

Index: one line for each capture, "key page_id file offset length type" with the URL's host
reversed (``org,example)/path``), sorted over all parts.  Each part packs its lines into
zlib blocks of ``BLOCK_LINES`` lines and ends in a sparse directory (first line's key,
offset, length of each block).  A look-up finds the part by its first key, binary-searches
the directory, reads the blocks that can hold the key, binary-searches their lines, and reads
just the record's range of the archive.  Only the parts' first keys are held at once: one for
each part, not for each capture or block.

Every file is written under a name of its own attempt, and only names that a successful task
returned are read.  A null html is an empty payload, a null url an empty key; page_ids must
be unique, and rows without one are left out (nothing could refer to them).  Other columns
are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, join_by_key

REVISIT_BYTES = 100
BLOCK_LINES = 512
INDEX_MAGIC = b"KSCDX001"
DATE = "2024-01-01T00:00:00Z"  # captures carry no time; a fixed one keeps archives reproducible


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def surt(url: str | None) -> str:
    """The key of a URL: host reversed and in lower case, port kept, scheme and fragment dropped; white space escaped."""
    rest = (url or "").partition("#")[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, colon, port = host.partition(":")
    key = ",".join(reversed(name.removesuffix(".").split("."))) + (colon + port if port else "") + ")" + (path or "/")
    return quote(key, safe="".join(chr(c) for c in range(33, 127)))


def record(page_id: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record, as a gzip member of its own."""
    target = quote(url or "", safe="".join(chr(c) for c in range(33, 127)))
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    data = ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"
    return gzip.compress(data, 5, mtime=0)


def parse(member: bytes) -> dict:
    """Header fields of a record, and its payload (None in a revisit)."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(out["Content-Length"])]
    out["payload"] = body.partition(b"\r\n\r\n")[2] if out["WARC-Type"] == "response" else None
    return out


def _page(urn: str) -> int:
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


CAPTURE = "key string, page_id long, file string, offset long, length long, type string"


def _archive(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = filesystem(folder)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for f in frames:
            rows = []
            for page, url, html, digest, size, refers in zip(f["page_id"], f["url"], f["html"], f["digest"], f["size"], f["refers_to"]):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                refers = None if pd.isna(refers) else int(refers)
                data = record(int(page), url, b"" if html is None else html.encode(), digest, int(size), refers)
                out.write(data)
                rows.append((surt(url), int(page), name, at, len(data), "response" if refers is None else "revisit"))
                at += len(data)
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length", "type"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every page; one row for each capture.  Materialise it: each run writes anew."""
    html = F.col("html").cast("string")
    p = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = p.select("*", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    # Digests are counted with map-side combine; hot ones are broadcast in the join back.
    first = p.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    p = join_by_key(p, first, "digest", pages.count(), "left", nulls=False).withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first")))
    return p.select("page_id", "url", "html", "digest", "size", "refers_to").mapInPandas(_archive(folder), CAPTURE)


class IndexPart:
    """One part of the index: a stream with seek and read."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - 24)
        tail = stream.read(24)
        if tail[16:] != INDEX_MAGIC:
            raise ValueError("not a part of a capture index")
        at, length = (int(x) for x in np.frombuffer(tail[:16], "<i8"))
        stream.seek(at)
        rows = [x.split(" ") for x in zlib.decompress(stream.read(length)).decode().splitlines()]
        self.firsts = [r[0] for r in rows]
        self.places = [(int(r[1]), int(r[2])) for r in rows]
        self._kept: tuple[int, list[list[str]]] = (-1, [])

    def block(self, i: int) -> list[list[str]]:
        if self._kept[0] != i:
            at, length = self.places[i]
            self.stream.seek(at)
            self._kept = (i, [x.split(" ") for x in zlib.decompress(self.stream.read(length)).decode().splitlines()])
        return self._kept[1]

    def find(self, key: str) -> Iterator[list[str]]:
        """All captures of a key, by page_id: the directory first, then lines of the blocks that can hold it."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            lines = self.block(i)
            k = bisect.bisect_left(lines, key, key=lambda r: r[0])
            while k < len(lines) and lines[k][0] == key:
                yield lines[k]
                k += 1
            i += 1


def _index(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = filesystem(folder)
        name, out, at, waiting, directory, low, last = f"index-{uuid.uuid4().hex}.cdx", None, 0, [], [], None, None

        def flush():
            nonlocal at, waiting
            data = zlib.compress("\n".join(" ".join(map(str, r)) for r in waiting).encode(), 6)
            out.write(data)
            directory.append(f"{waiting[0][0]} {at} {len(data)}")
            at += len(data)
            waiting = []

        for f in frames:
            for r in zip(f["key"], f["page_id"], f["file"], f["offset"], f["length"], f["type"]):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    low = r[0]
                last = r[0]
                waiting.append(r)
                if len(waiting) == BLOCK_LINES:
                    flush()
        if out is not None:
            if waiting:
                flush()
            data = zlib.compress("\n".join(directory).encode(), 6)
            out.write(data + np.array([at, len(data)], "<i8").tobytes() + INDEX_MAGIC)
            out.close()
            yield pd.DataFrame({"part": [name], "low": [low], "high": [last]})

    return run


def write_index(captures: DataFrame, folder: str, parts: int) -> DataFrame:
    """Sort captures by key into index parts; one row for each: part, low, high (its first and last key)."""
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInPandas(_index(folder), "part string, low string, high string")


FOUND = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _look_up(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store, path = filesystem(folder)
        rows, open_files = [], {}
        with store.open_input_file(f"{path}/{pdf['part'].iloc[0]}") as stream:
            part = IndexPart(stream)
            wanted = [hit for key in sorted(set(pdf["key"])) for hit in part.find(key)]
        for key, page, file, offset, length, kind in sorted(wanted, key=lambda h: (h[2], int(h[3]))):
            if file not in open_files:
                for f in open_files.values():
                    f.close()
                open_files = {file: store.open_input_file(f"{path}/{file}")}
            open_files[file].seek(int(offset))
            r = parse(open_files[file].read(int(length)))
            if r["WARC-Type"] != kind or _page(r["WARC-Record-ID"]) != int(page):
                raise ValueError(f"the index doesn't fit {file} at {offset}")
            digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
            if r["payload"] is not None and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != int(r["X-Payload-Length"])):
                raise ValueError(f"damaged payload in {file} at {offset}")
            rows.append((key, int(page), int(r["X-Payload-Length"]), digest, kind, _page(r["WARC-Refers-To"]) if kind == "revisit" else None))
        for f in open_files.values():
            f.close()
        out = pd.DataFrame(rows, columns=["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return out.astype({"refers_to": "Int64"})

    return run


def look_up(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """All captures of the URL keys given (column key), read back from the archives.

    index: what ``write_index`` returned.  A key's captures may span parts, so a key goes to
    every part whose range holds it; within a part it is looked up once, however often it is asked.
    """
    rows = sorted(index.collect(), key=lambda r: (r["low"], r["high"]))  # one for each part
    if not rows:
        return keys.sparkSession.createDataFrame([], FOUND)
    names, lows, highs = [r["part"] for r in rows], [r["low"] for r in rows], [r["high"] for r in rows]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key in f["key"]:
                i = max(0, bisect.bisect_left(highs, key))
                while i < len(names) and lows[i] <= key:
                    out.append((key, names[i]))
                    i += 1
            yield pd.DataFrame(out, columns=["key", "part"])

    placed = keys.select("key").distinct().mapInPandas(place, "key string, part string")
    return placed.repartition(max(1, len(rows)), "part").groupBy("part").applyInPandas(_look_up(folder), FOUND)


def url_keys(pages: DataFrame) -> DataFrame:
    """The distinct index keys of a table's URLs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": [surt(u) for u in f["url"]]})

    return pages.where("page_id is not null").select(F.col("url").cast("string").alias("url")).mapInPandas(run, "key string")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archive"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = scratch.table(write_archives(pages, folder), "captures")
    index = scratch.table(write_index(captures, folder, int(spark.conf.get("spark.sql.shuffle.partitions"))), "index")
    return look_up(url_keys(pages), index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""
