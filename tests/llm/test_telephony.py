import hashlib
import zlib

import numpy as np

from stratalog.llm import telephony
from tests.llm.conftest import by_id


def scalar_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            change = int(telephony.STEPS[index]) * (2 * (nibble & 7) + 1) >> 3
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
            out.append(value)
    return out


def test_tables_of_the_standard():
    mu, a = telephony.TABLES[telephony.MU_LAW], telephony.TABLES[telephony.A_LAW]
    assert [int(mu[c]) for c in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(a[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def test_adpcm_across_blocks_is_the_scalar_decoder():
    blocks = np.random.default_rng(1).integers(0, 256, (60, 64), dtype=np.uint8)
    assert telephony.decode_ima(blocks).tolist() == [scalar_ima(bytes(b)) for b in blocks]


def test_files_round_trip_and_broken_ones_say_why():
    data = bytes(range(64))
    for tag in (telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM, telephony.PCM):
        assert telephony.unwrap(telephony.wrap(data, tag, block=64 if tag == telephony.IMA_ADPCM else 1))[3] == data
    for broken in (b"", b"RIFF", telephony.wrap(data)[:-1], b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd"):
        try:
            telephony.samples(broken)
        except ValueError:
            continue
        raise AssertionError(broken)


def test_pcm_columns(spark):
    media = [(1, telephony.wrap(b"\xff\x00" * 32)), (2, None), (3, b"junk"), (4, telephony.wrap(bytes(64), telephony.IMA_ADPCM, block=64))]
    rows = by_id(telephony.pcm_columns(spark.createDataFrame(media, "doc_id long, media binary")))
    assert np.frombuffer(rows[1].pcm, dtype="<i2")[:4].tolist() == [0, -16062, -32124, -16062] and rows[1].rate == 16000
    assert (rows[2].pcm, rows[2].error, rows[3].pcm) == (None, "null", None) and len(rows[4].pcm) == 2 * 2 * 121


def scalar_feature(payload):
    """The features of one payload, sample by sample."""
    pcm, crc = {}, {}
    for name, tag in (("pcm16k", telephony.MU_LAW), ("alaw16k", telephony.A_LAW)):
        pcm[name] = [int(telephony.TABLES[tag][b]) for b in payload]
        twice = [v for a, b in zip(pcm[name], [*pcm[name][1:], pcm[name][-1]], strict=True) for v in (a, (a + b) >> 1)]
        crc[name] = zlib.crc32(np.array(twice, dtype="<i2").tobytes())
    mu = pcm["pcm16k"]
    blocks = [v for k in range(0, len(payload), 64) for v in scalar_ima(payload[k : k + 64])]
    turns = sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:], strict=False))
    return f"peak={max(map(abs, mu))};mean={sum(map(abs, mu)) // len(mu)};turns={turns};pcm16k={crc['pcm16k']:08x};alaw16k={crc['alaw16k']:08x};adpcm={zlib.crc32(np.array(blocks, dtype='<i2').tobytes()):08x}"


def test_features_in_slices_are_those_of_single_samples(monkeypatch):
    monkeypatch.setattr(telephony, "SLICE", 256)
    rng = np.random.default_rng(2)
    sizes = np.array([64, 128, 1024, 64, 640, 64])
    to, data = np.concatenate(([0], np.cumsum(sizes))), rng.integers(0, 256, sizes.sum(), dtype=np.uint8)
    assert telephony.features(data, to) == [scalar_feature(bytes(data[a:b])) for a, b in zip(to[:-1], to[1:], strict=True)]


def test_store(spark, docs_of):
    texts = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (5, "x" * 65), (6, "y" * 400_000)]
    stored = telephony.store(docs_of(texts).selectExpr("*", "1 AS media", "2 AS n_bytes")).cache()
    rows, files = by_id(telephony.measure(stored)), by_id(stored)
    pcm = by_id(telephony.pcm_columns(stored))
    for doc_id, text in texts:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, media = rows[doc_id], bytes(files[doc_id].media)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert telephony.unwrap(media)[3] == payload
        assert f"pcm16k={zlib.crc32(pcm[doc_id].pcm):08x}" in r.feature
        if len(payload) < 1000:
            assert r.feature == scalar_feature(payload)
    assert rows[4].feature == rows[5].feature != rows[6].feature
    assert telephony.measure(telephony.store(docs_of([]))).count() == 0
