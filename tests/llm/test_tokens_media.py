import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import bitplane, media, rollups, tokenize
from lexmill.llm.queries import vocabulary
from lexmill.llm.tokenize import TextTokenizer


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, documents, monkeypatch):
    import random

    ours = TextTokenizer(vocabulary())
    rng = random.Random(5)
    bits = list(" \n\tab1'sé.! \r\0") + ["  ", " \n", "'ll", "日", "\x1c", "\xa0", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [r.text for r in documents.limit(40).collect()]
    for t in texts:
        assert np.frombuffer(ours.ids(t), dtype="<u4").tolist() == library(t), t[:60]
    assert ours.ids(None) == b""
    for chunk in (100, 1 << 20):
        monkeypatch.setattr(tokenize, "CHUNK", chunk)
        found = list(ours.batches(pa.array([None, *texts], pa.string())))
        assert np.concatenate([n for _, n in found]).tolist() == [0, *(len(library(t)) for t in texts)]
        assert np.concatenate([x for x, _ in found]).tolist() == [i for t in texts for i in library(t)]


def _expected(docs, library):
    """The rows by doc_id, then by the hash of the text."""
    start = 0
    for doc_id, text, _ in sorted(docs.select("doc_id", "text", F.xxhash64("text")).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = np.array([*library(text), 0], dtype="<u4").tobytes()
        yield doc_id, start, len(ids) // 4, zlib.crc32(ids)
        start += len(ids) // 4


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_shards_hold_the_ids_in_order(odd_docs, no_docs, library, mode):
    shards = bitplane.write_shards(odd_docs, vocabulary(), mode=mode, shard_ids=500)
    assert shards.count() > 2
    found = sorted((tuple(r) for r in bitplane.read_shards(shards).collect()), key=lambda r: r[1])
    assert found == list(_expected(odd_docs, library))
    assert bitplane.encode_and_read(no_docs, vocabulary()).count() == 0


def test_shards_of_documents(documents, library):
    found = sorted((tuple(r) for r in bitplane.encode_and_read(documents, vocabulary()).collect()), key=lambda r: r[1])
    assert found == list(_expected(documents, library))


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("count", [0, 1, 7, 4096, 10_001])
def test_shard_round_trip(mode, count):
    ids = np.random.default_rng(count).integers(0, 1 << 32, count, dtype=np.uint64).astype("<u4")
    data = bitplane.encode_shard([None, -5], [count, 0], ids, mode, block=1000)
    shard = bitplane.Shard(data)
    assert (shard.read() == ids).all() and (shard.read(995, 2005) == ids[995:2005]).all()
    assert shard.documents == [(None, 0, count), (-5, count, 0)]
    with pytest.raises(ValueError):
        bitplane.Shard(data[:-1] + bytes([data[-1] ^ 1]))


def test_media_round_trip(odd_docs, no_docs):
    texts = {}
    for r in media.text_media(odd_docs.limit(1000)).collect():
        texts.setdefault(r.doc_id, r)
    for r in odd_docs.collect():
        if r.doc_id in (None, 1):
            continue
        raw = (r.text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        m = texts[r.doc_id]
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        stored = media.encode(padded)
        assert (m.media_bytes, m.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.text_media(no_docs).count() == 0
    assert media.text_media(odd_docs).count() == odd_docs.count()


def test_frames_durations_and_offsets():
    stream = media.encode(b"x" * 937 * 3 + b"y" * 10)
    found = media.probe(stream)
    assert len(found.offsets) == 4 == found.vbr_frames and found.vbr == "Xing" and len(found.seek) == 100
    assert found.duration == 4 * media.Fraction(1152, 48000) and found.crc_checked == 5 and not found.crc_wrong and not found.skipped
    assert all(stream[o] == 0xFF for o in found.offsets) and found.tags == ["PRIV"]


def test_resynchronises_after_damage():
    stream = media.encode(bytes(range(256)) * 30)
    found = media.probe(stream)
    cut = found.offsets[2]
    damaged = stream[:cut] + b"\xff\x00junk\xff\xfb" + stream[cut:] + b"TAG" + bytes(125)
    again = media.probe(damaged)
    assert len(again.offsets) == len(found.offsets) and again.skipped == 8 and sorted(again.tags) == ["ID3v1", "PRIV"]
    bad = bytearray(stream)
    bad[found.offsets[1] + 4] ^= 1
    assert media.probe(bytes(bad)).crc_wrong == 1
    with pytest.raises(ValueError):
        media.payload(bytes(bad), media.probe(bytes(bad)))
    for junk in (b"", b"\xff", b"\xff" * 300, b"ID3", bytes(1000)):
        media.probe(junk)


def _bit_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ b
        crc = (crc << 1) & 0xFFFF
        crc ^= 0x8005 if top else 0
    return crc


def _bits(data, count):
    return [data[k >> 3] >> 7 - (k & 7) & 1 for k in range(count)]


@pytest.mark.parametrize(
    "word, covered",
    [
        (0xFFFE80C4 & ~0x10000, lambda f: 128),  # Layer I, mono: 32 allocations of 4 bits
        (0xFFFE8004 & ~0x10000, lambda f: 256),  # Layer I, stereo
        (0xFFFE8054 & ~0x10000, lambda f: 4 * (2 * 8 + 24)),  # Layer I, joint from subband 8 on
        (0xFFFC84C4, lambda f: None),  # Layer II, 128 kbit/s mono at 48 kHz: 27 subbands
    ],
)
def test_checksums_of_layers_one_and_two(word, covered):
    h = media.header(word)
    assert h.protected and h.layer in (1, 2)
    frame = bytearray(word.to_bytes(4, "big") + bytes((k * 37 + 11) % 256 for k in range(h.size - 4)))
    count = covered(frame)
    if count is None:
        widths = [4] * 11 + [3] * 12 + [2] * 4
        bits, at, used = _bits(frame[6:], 200), 0, 0
        for w in widths:
            used += any(bits[at : at + w])
            at += w
        count = at + 2 * used
    crc = _bit_crc(_bits(frame[2:4], 16) + _bits(frame[6:], count))
    frame[4:6] = crc.to_bytes(2, "big")
    assert (media.probe(bytes(frame) * 3).crc_checked, media.probe(bytes(frame) * 3).crc_wrong) == (3, 0)
    frame[7] ^= 1
    assert media.probe(bytes(frame) * 3).crc_wrong == 3


def test_tables_of_variable_bitrate():
    word = 0xFFFB9444  # MPEG-1 Layer III, 128 kbit/s, 48 kHz, joint stereo
    h = media.header(word)
    body = bytearray(h.size)
    body[:4] = word.to_bytes(4, "big")
    plain = bytes(body)
    sizes = [h.size // 2, h.size, h.size * 2]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 9999, 3, 3, 2, 2, 1) + struct.pack(">3H", *sizes)
    body[36 : 36 + len(table)] = table
    found = media.probe(bytes(body) + plain * 3)
    assert (found.vbr, found.vbr_bytes, found.vbr_frames, len(found.offsets)) == ("VBRI", 9999, 3, 3) and list(struct.unpack("<3I", found.seek)) == [2 * x for x in sizes]
    # a 24-byte MPEG-2 frame has no room for a table
    short = media.header(0xFFF314C4)
    assert short.size == 24
    frame = bytearray(0xFFF314C4.to_bytes(4, "big") + bytes(20))
    frame[short.body : short.body + 4] = b"Xing"
    assert media.probe(bytes(frame) * 3).skipped == 0


def test_any_bytes_can_be_probed():
    import random

    rng = random.Random(1)
    for _ in range(3000):
        data = bytearray(rng.randbytes(rng.randint(0, 300)))
        for at in rng.sample(range(300), 3):
            if at + 4 <= len(data):
                data[at : at + 4] = rng.choice([bytes([0xFF, rng.choice([0xFA, 0xFB, 0xF2, 0xF3, 0xFC, 0xFE, 0xE2]), rng.randrange(256), rng.randrange(256)]), b"Xing", b"VBRI", b"ID3\3"])
        found = media.probe(bytes(data))
        assert all(data[o] == 0xFF for o in found.offsets)
    # a false frame before the end has no successor
    assert media.probe(bytes.fromhex("fffb9444") + bytes(380) + b"ab").offsets == []


def test_headers_of_other_layers():
    two = media.header(0xFFFD8404)  # MPEG-1 layer II, 128 kbit/s, 48 kHz
    assert (two.layer, two.bitrate, two.sample_rate, two.size, two.samples) == (2, 128, 48000, 384, 1152)
    low = media.header(0xFFF38464)  # MPEG-2 layer III, 64 kbit/s, 24 kHz
    assert (low.version, low.bitrate, low.sample_rate, low.samples, low.size) == (2, 64, 24000, 576, 192)
    assert media.header(0xFFFF0000) is None and media.header(0x12345678) is None


def test_signed_deltas(spark):
    schema = "change string, source string, lang string, tokenizer_version string, tokens long, bytes long, old_tokens long, old_bytes long"
    rows = [("insert", "a", "en", "v1", 10, 100, None, None), ("insert", None, "en", "v1", 5, 50, None, None), ("delete", "a", "en", "v1", 4, 40, None, None), ("revise", "a", "en", "v1", 12, 100, 10, 100)]
    found = {r.source: (r.docs, r.tokens, r["bytes"]) for r in rollups.signed(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": (0, 8, 60), None: (1, 5, 50)}
    with pytest.raises(Exception, match="unknown change"):
        rollups.signed(spark.createDataFrame([("upsert", *rows[0][1:])], schema)).collect()


def test_batches_count_once(spark, tmp_path):
    schema = "source string, lang string, tokenizer_version string, docs long, tokens long, bytes long"
    store = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0
    batch = spark.createDataFrame([("a", "en", "v1", 2, 20, 200)], schema)
    assert store.commit("b1", batch) and not store.commit("b1", batch)
    # a crash half-way leaves a folder that no marker names; it doesn't count and the batch may be sent again
    batch.write.parquet(f"file://{tmp_path}/r/deltas/batch=b2/attempt")
    assert store.committed("b1") and not store.committed("b2") and [r.docs for r in store.totals().collect()] == [2]
    assert store.commit("b2", spark.createDataFrame([("a", "en", "v1", -1, -5, -50), ("b", "en", "v1", 0, 0, 0)], schema))
    before = sorted(map(tuple, store.totals().collect()))
    assert before == [("a", "en", "v1", 1, 15, 150)]
    store.compact()
    assert sorted(map(tuple, store.totals().collect())) == before and not store.commit("b2", batch)
    assert store.commit("b3", batch) and store.totals().first().docs == 3
    # the next compactions drop the folders that were folded before, and nothing counts twice
    for _ in range(2):
        store.compact()
        assert store.totals().first().docs == 3 and not store.commit("b1", batch) and not store.commit("b3", batch)
    assert not any((tmp_path / "r" / "deltas" / f"batch={b}").exists() for b in ("b1", "b2"))
    assert store.commit("b4", batch) and store.totals().first().docs == 5


def test_a_late_losing_writer_changes_nothing(spark, tmp_path):
    """Its folder comes back after the batch was folded and dropped, with the marker of the attempt that won."""
    schema = "source string, lang string, tokenizer_version string, docs long, tokens long, bytes long"
    batch = spark.createDataFrame([("a", "en", "v1", 2, 20, 200)], schema)
    store = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert store.commit("b", batch)
    for _ in range(2):
        store.compact()
    assert not (tmp_path / "r" / "deltas" / "batch=b").exists()
    late = rollups.Rollup(spark, f"file://{tmp_path}/r")
    late.committed = lambda _: False  # it had looked before the other one committed
    assert not late.commit("b", batch)
    batch.write.parquet(f"file://{tmp_path}/r/deltas/batch=b/of-a-writer-that-died")
    for _ in range(3):
        assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 2, 20, 200)]
        store.compact()
    assert store.commit("c", batch) and store.totals().first().docs == 4


def test_one_of_two_writers_of_a_batch_counts(spark, tmp_path):
    schema = "source string, lang string, tokenizer_version string, docs long, tokens long, bytes long"
    one, two = rollups.Rollup(spark, f"file://{tmp_path}/r"), rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert one._mark(f"{one.path}/batches/b", "mine") and not two._mark(f"{two.path}/batches/b", "theirs")
    assert one._read(f"{one.path}/batches/b") == "mine" and not two.commit("b", spark.createDataFrame([("a", "en", "v1", 2, 20, 200)], schema))
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        assert one.commit("c", spark.createDataFrame([("a", "en", "v1", 2, 20, 200)], schema)) and two.committed("c")
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_corpus_rollup(documents, no_docs, library, tmp_path):
    rows = {}
    for r in documents.orderBy("doc_id").collect():
        rows.setdefault(r.text, r)
    expected = {}
    for r in rows.values():
        old = expected.get((r.source, r.lang), (0, 0, 0))
        expected[r.source, r.lang] = (old[0] + 1, old[1] + len(library(r.text)) + 1, old[2] + len(r.text.encode()))
    found = rollups.corpus_rollup(documents, vocabulary(), "v1", f"file://{tmp_path}/a")
    assert {(r.source, r.lang): (r.docs, r.tokens, r["bytes"]) for r in found.collect()} == expected
    assert rollups.corpus_rollup(no_docs, vocabulary(), "v1", f"file://{tmp_path}/b").count() == 0


def test_added_tokens_get_the_ids_of_the_library(spark):
    from lexmill.llm.tokenize import loaded

    plain = Tokenizer.from_file(vocabulary())
    texts = ["abc <|endoftext|> def", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n", "<|endoftext|", "no token", ""]
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [39305, 220, 50256, 825]
    assert [np.frombuffer(loaded(vocabulary()).ids(t), dtype="<u4").tolist() for t in texts] == ids
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = sorted((tuple(r) for r in bitplane.encode_and_read(docs, vocabulary()).collect()), key=lambda r: r[1])
    assert found == list(_expected(docs, lambda t: plain.encode(t, add_special_tokens=False).ids))
    assert {r.doc_id: r.tokens for r in rollups.token_counts(docs, vocabulary()).collect()} == {k: len(x) for k, x in enumerate(ids)}


def test_one_of_equal_rows_and_of_null_ids_stays(spark, tmp_path):
    rows = [(None, "one", "en", "a"), (None, "two words", "en", "a"), (1, "two words", "en", "a"), (None, "two words", "en", "a"), (2, "three", "en", "a"), (2, "three", "en", "a"), (None, "one", "en", "a"), (3, None, None, None), (3, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plain = Tokenizer.from_file(vocabulary())
    tokens = sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in ("one", "two words", "three"))
    found = rollups.corpus_rollup(docs, vocabulary(), "v1", f"file://{tmp_path}/r").collect()
    assert {(r.source, r.docs, r.tokens, r["bytes"]) for r in found} == {("a", 3, tokens, 17), (None, 1, 1, 0)}
