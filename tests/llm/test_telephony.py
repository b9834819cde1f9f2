import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from gridloom.llm import telephony as tel


def one_block(block):
    """IMA ADPCM of one block, a sample at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(tel.MOVES[code & 7])))
            out.append(value)
    return out


def test_expansion_tables():
    assert tel.EXPAND["mulaw"][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert tel.EXPAND["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for table in tel.EXPAND.values():  # the halves mirror each other
        assert sorted(table.tolist()) == sorted((-table).tolist())


def test_adpcm_equals_a_scalar_decoder():
    data = np.random.default_rng(1).integers(0, 256, 64 * 50, dtype=np.uint8)
    assert tel.adpcm_blocks(data).tolist() == [one_block(bytes(b)) for b in data.reshape(-1, 64)]


def test_doubling_keeps_samples_and_signals_apart():
    a, b = np.arange(-50, 70, dtype=np.int16) * 100, np.array([32767, -32768, 5], np.int16)
    both = tel.doubled(np.concatenate([a, b]), np.array([len(a), len(b)]))
    assert (both[::2] == np.concatenate([a, b])).all()
    assert (both[: 2 * len(a)] == tel.doubled(a, np.array([len(a)]))).all() and (both[2 * len(a) :] == tel.doubled(b, np.array([3]))).all()
    x = np.concatenate([np.zeros(4), a, np.zeros(4)]).astype(int)
    n = 17
    want = (sum(t * (x[4 + n - k] + x[5 + n + k]) for k, t in enumerate(tel.TAPS)) + (1 << 14)) >> 15
    assert both[2 * n + 1] == want


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm", "pcm"])
def test_container_round_trip(codec):
    data = bytes(range(64)) * 3
    assert (lambda c, r, d: (c, r, bytes(d)))(*tel.unwav(tel.wav(data, codec))) == (codec, 8000, data)
    with pytest.raises(ValueError):
        tel.unwav(b"RIFFxxxxWAVE")


def test_payload_and_media_of_every_row(odd):
    rows = odd.select("doc_id", "text").collect()
    got = tel.stored_features(odd).collect()
    def expect(r):
        body = (r.text or "").encode()
        payload = body + bytes(-len(body) % 64 if body else 64)
        media = tel.wav(payload)
        return (r.doc_id, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    key = lambda r: str(r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(map(expect, rows), key=key)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(v) == 1 for v in by_text.values())


def test_features_do_not_depend_on_the_neighbours(odd, spark):
    alone = tel.stored_features(odd.where("doc_id = 9")).first().feature
    assert alone == tel.stored_features(odd).where("doc_id = 9").first().feature


def test_stored_pcm(odd, tmp_path, spark):
    media = tel.encode(odd.where("doc_id in (5, 9)"), codec="adpcm")
    tel.store_pcm(media, str(tmp_path / "pcm"))
    row = spark.read.parquet(str(tmp_path / "pcm")).where("doc_id = 9").first()
    codec, rate, data = tel.unwav(row.pcm)
    assert (codec, rate) == ("pcm", 16000) and len(data) == 2 * row.pcm_samples
    assert (np.frombuffer(data, "<i2")[::2] == tel.samples_of(*(lambda c, r, d: (c, d))(*tel.unwav(row.media)))).all()


def test_the_query_stores_pcm_and_describes_what_is_stored(odd, spark, monkeypatch):
    paths, store = [], tel.store_pcm
    monkeypatch.setattr(tel, "store_pcm", lambda media, path, *a: (paths.append(path), store(media, path, *a)))
    got = {r.doc_id: r for r in tel.stored_features(odd.where("doc_id in (9, 10)")).collect()}
    stored = spark.read.parquet(*paths)
    for r in stored.collect():
        codec, rate, data = tel.unwav(r.pcm)
        assert (codec, rate, len(data)) == ("pcm", 16000, 4 * got[r.doc_id].payload_bytes)
        assert got[r.doc_id].feature.split(";")[0].endswith(f":{zlib.crc32(data)}")
    silent = stored.rdd.map(lambda r: (r.doc_id, r.n_bytes, r.media, tel.wav(bytes(2 * r.pcm_samples), "pcm", 16000)))
    other = tel.features(spark.createDataFrame(silent, "doc_id long, n_bytes long, media binary, pcm binary")).collect()
    assert all(f":0:0:0:{zlib.crc32(bytes(4 * r.payload_bytes))};" in r.feature for r in other)


def test_coded_pcm_is_decoded_without_loss():
    """Levels of either law, other samples, second samples that are not the predicted ones, extremes and nothing at all."""
    rng = np.random.default_rng(3)
    levels = {law: rng.choice(table, 90) for law, table in tel.EXPAND.items()}
    apart = np.setdiff1d(tel.EXPAND["alaw"], tel.EXPAND["mulaw"])[:64].astype(np.int16)
    signals = [tel.doubled(x, np.array([len(x)])) for x in (levels["mulaw"], levels["alaw"], apart, rng.integers(-32768, 32768, 70).astype(np.int16))]
    signals += [rng.integers(-32768, 32768, 64).astype(np.int16), np.tile(np.array([32767, -32768, -32768], np.int16), 20), np.zeros(0, np.int16), np.zeros(8, np.int16)]
    coded = tel.halves(np.concatenate(signals), np.array([len(x) for x in signals]))
    assert [(c[0], c[1]) for c in coded[:5]] == [(1, 0), (2, 0), (2, 0), (0, 0), (0, 1)]
    assert [len(c) for c in coded[:5]] == [92, 92, 66, 142, 130]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(tel.joined(coded), signals, strict=True))
    for c, x in zip(coded, signals):
        file = tel.wav(c, "halves", 16000)
        codec, rate, data = tel.unwav(file)
        assert (codec, rate, bytes(data)) == ("pcm", 16000, x.astype("<i2").tobytes())
        assert int.from_bytes(file[file.index(b"fact") + 8 :][:4], "little") == len(x)


def test_interpolation_holds_at_the_extremes():
    """The largest sum of the taps, either way, is clipped and not wrapped."""
    x = np.where(np.array([t > 0 for t in tel.TAPS[::-1] + tel.TAPS]), 32767, -32768).astype(np.int16)
    for sign in (1, -1):
        signal = np.where(x > 0, 32767, -32768) if sign > 0 else np.where(x > 0, -32768, 32767)
        want = (sum(t * (int(signal[3 - k]) + int(signal[4 + k])) for k, t in enumerate(tel.TAPS)) + (1 << 14)) >> 15
        assert tel.between(signal.astype(np.int16), np.array([8]))[3] == max(-32768, min(32767, want))


def test_media_and_pcm_fit_the_disk_limit(spark, tmp_path):
    """On texts of the given kind, media and PCM on disk stay below one and a half times the texts as Snappy Parquet."""
    rng = np.random.default_rng(7)
    known = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 10))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(known[int(w) % 3000] for w in rng.zipf(1.3, 300))) for k in range(2000)], "doc_id long, text string").coalesce(1)
    docs.write.option("compression", "snappy").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    tel.store_pcm(tel.encode(docs), str(tmp_path / "media"))
    size = lambda d: sum(f.stat().st_size for f in (tmp_path / d).glob("*.parquet"))
    assert size("media") < 1.5 * size("docs")


def test_every_sample_of_the_pcm_is_stored(odd, spark, monkeypatch):
    """What is stored is a PCM file that any reader opens, the interpolated samples in it."""
    paths, store = [], tel.store_pcm
    monkeypatch.setattr(tel, "store_pcm", lambda media, path, *a: (paths.append(path), store(media, path, *a)))
    tel.stored_features(odd).collect()
    rows = spark.read.parquet(*paths).collect()
    assert len(rows) == odd.count()
    for r in rows:
        heard = tel.samples_of("mulaw", tel.unwav(bytes(r.media))[2])
        with wave.open(io.BytesIO(bytes(r.pcm))) as f:
            assert (f.getframerate(), f.getsampwidth(), f.getnchannels(), f.getnframes()) == (16000, 2, 1, 2 * len(heard))
            assert f.readframes(f.getnframes()) == tel.doubled(heard, np.array([len(heard)])).astype("<i2").tobytes()


def test_null_media_beside_others(spark):
    rows = [(1, None), (2, bytearray(tel.wav(bytes(range(64))))), (3, None), (4, bytearray(tel.wav(b""))), (5, bytearray(tel.wav(bytes(64), "adpcm")))]
    got = {r.doc_id: r for r in tel.resampled(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).collect()}
    assert {k: r.pcm_samples for k, r in got.items()} == {1: None, 2: 128, 3: None, 4: 0, 5: 242}
    assert got[1].pcm is None and got[3].pcm is None
    assert all(len(tel.unwav(got[k].pcm)[2]) == 2 * got[k].pcm_samples for k in (2, 4, 5))
    assert [r.pcm for r in tel.resampled(spark.createDataFrame(rows[:1], "doc_id long, media binary")).collect()] == [None]


def test_empty_table(no_docs):
    assert tel.stored_features(no_docs).count() == 0
