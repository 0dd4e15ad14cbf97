import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import tokenids, warc
from keystrata.llm.store import Scratch

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.mark.parametrize("width", [1, 5, 11, 16, 17, 24, 32])
def test_pack_and_random_access(width):
    r = np.random.default_rng(width)
    ids = r.integers(0, 2**width, 200_000 if width == 17 else 3000, dtype=np.uint64).astype(np.uint32)
    assert (tokenids.unpack(tokenids.pack(ids, width), len(ids), width) == ids).all()
    out = io.BytesIO()
    out.close = lambda: None
    w = tokenids.IdWriter(out, width)
    sizes = np.array([0, 1000, 1, len(ids) - 1001])
    w.add(np.arange(2), sizes[:2], ids[:1000])
    w.add(np.arange(2, 4), sizes[2:], ids[1000:])
    w.close()
    reader = tokenids.IdReader(out)
    assert reader.width == width and (reader.sizes == sizes).all()
    for a, n in ((0, 0), (5, 700), (len(ids) - 3, 3), (0, len(ids))):
        assert (reader.ids(a, n) == ids[a : a + n]).all()
    assert (reader.document(1) == ids[:1000]).all()
    damaged = bytearray(out.getvalue())
    damaged[-60] ^= 1
    with pytest.raises(ValueError):
        tokenids.IdReader(io.BytesIO(bytes(damaged)))


TEXTS = [None, "", "  \n", "Hello, world!", "it's 'tis don't! x's. 42nd (e.g.) a-b_c", "é, É. ñandú… ¿Qué? naïve! é .́x", "a<|endoftext|>b <|STARTOFTEXT|>", "İstanbul ΣΑΣ ﬁ 漢字。x y z\x85w", "#!?'s ?'s \"q\" a1b2 $5.00 &&&*** x***y", "w" * 3000, "ab. " * 3000, "😀👍🏽 ok.'ve"]


def test_pieces_equal_the_tokenizer(monkeypatch):
    t = tokenizers.Tokenizer.from_file(PATH)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    for kept in (1 << 21, 8):
        monkeypatch.setattr(tokenids, "KEPT_PIECES", kept)
        coder = tokenids.PieceEncoder(PATH)
        for part in ([x] for x in TEXTS):
            ids, sizes = coder.encode(pa.array(part, pa.string()))
            assert ids.tolist() == want[TEXTS.index(part[0])] and sizes.sum() == len(ids)
        ids, sizes = coder.encode(pa.array(TEXTS * 2, pa.string()))
        assert ids.tolist() == [i for w in want * 2 for i in w] and sizes.tolist() == [len(w) for w in want * 2]


def test_token_files(spark, tmp_path):
    rows = [(i * 7 % len(TEXTS), x, "n", 1) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string, base int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tokenids.op6_token_ids(spark, str(tmp_path)).collect())
    t, start = tokenizers.Tokenizer.from_file(PATH), 0
    for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_and_null_token_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert tokenids.op6_token_ids(spark, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/n/documents.parquet")
    assert [(r["doc_id"], r["start"]) for r in sorted(tokenids.op6_token_ids(spark, f"{tmp_path}/n").collect(), key=lambda r: r["start"])] == [(None, 0), (1, 2), (1, 4)]


def test_ids_of_many_texts_spread_in_order(spark, tmp_path):
    """Half of the rows have no id, others share the least possible one: several files, starts without a gap."""
    rows = [(None, f"w{i}") for i in range(400)] + [(-(1 << 63), f"x {i}") for i in range(200)] + [(5, None), (5, ""), (6, "y" * 70_000)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    files = tokenids.write_token_ids(docs, f"{tmp_path}/ids", PATH).collect()
    assert sum(r["low"] is None for r in files) > 1
    got = sorted(tokenids.op6_token_ids(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert [r["doc_id"] for r in got] == [None] * 400 + [-(1 << 63)] * 200 + [5, 5, 6]
    t = tokenizers.Tokenizer.from_file(PATH)
    want = [(d, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for d, x in rows]
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)


def pages():
    big = "<html>" + "ä" * 100 + "</html>"
    rows = [(5, "http://A.example.com/x?q=1#f", big), (2, "https://b.example.com", big), (9, "http://a.example.com/x?q=1", big), (1, None, None), (3, "http://a.example.com/", ""), (4, "http://u@a.example.com:80/ sp", "short"), (6, "http://c.org", "short"), (7, "", "y" * 100), (8, "http://c.org", "y" * 99)]
    return [(p, u, h, "d", 0) for p, u, h in rows]


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    spark.createDataFrame(pages() + [(None, "http://no.id", "x", "d", 0)], "page_id long, url string, html string, digest string, size int").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in warc.op2_warc_index(spark, str(tmp_path)).collect()}
    first: dict = {}
    for p, _, h, *_ in sorted(pages()):
        data = (h or "").encode()
        own = first.setdefault(data, p) if len(data) >= 100 else p
        r = got.pop(p)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == p else ("revisit", own))
    assert not got
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert warc.op2_warc_index(spark, f"{tmp_path}/e").count() == 0


def test_index_look_up(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    n = 200
    rows = [(i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i} " * 20) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    captures = scratch.table(warc.write_archives(df, f"{scratch.path}/a"), "c")
    index = scratch.table(warc.write_index(captures, f"{scratch.path}/a", 4), "i")
    asked = [rows[3][1], rows[60][1], "http://nowhere.org/"]
    keys = spark.createDataFrame([(warc.surt(u),) for u in asked + asked], "key string")
    got = sorted(r["page_id"] for r in warc.look_up(keys, index, f"{scratch.path}/a").collect())
    assert got == sorted(i for i, u, _ in rows if u in asked)


def test_surt_and_records():
    assert warc.surt("http://WWW.Example.org:8080/A?b#c") == "org,example,www:8080)/A?b" and warc.surt(None) == ")/"
    assert warc.surt("https://x.y./p q") == "y,x)/p%20q"
    for payload in (b"", b"a\r\n\r\nb", bytes(range(256))):
        r = warc.parse(warc.record(3, "http://x/\r\ny", payload, "d", len(payload), None))
        assert r["payload"] == payload and r["WARC-Type"] == "response" and "\n" not in r["WARC-Target-URI"]
    r = warc.parse(warc.record(3, "u", b"zz", "d", 2, 1))
    assert r["payload"] is None and r["WARC-Refers-To"] == "<urn:page:1>" and r["X-Payload-Length"] == "2"
