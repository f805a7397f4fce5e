import hashlib
import zlib

import numpy as np
import pytest

from sitelens.llm import audio


def test_resample_is_the_direct_sum():
    x = np.random.default_rng(1).normal(size=301).astype(np.float32)
    half, up, down = len(audio._H) // 2, audio.UP, audio.DOWN
    want = [sum(float(audio._H[k]) * float(x[(m * down + half - k) // up]) for k in range(len(audio._H)) if (m * down + half - k) % up == 0 and 0 <= (m * down + half - k) // up < len(x)) for m in range(-(-len(x) * up // down))]
    assert np.allclose(audio.resample(x), want, atol=1e-4)


def test_blocks_change_nothing(monkeypatch):
    x = np.random.default_rng(2).integers(0, 256, 40_000).astype(np.uint8)
    whole = audio.log_mel(x)
    monkeypatch.setattr(audio, "BLOCK", 17)
    assert np.abs(audio.log_mel(x) - whole).max() <= 1 / 16


def test_hysteresis():
    assert audio.segments(np.array([0, 1, 0.5, 0.45, 0.3, 0.5, 0.7, 0.0])) == [(1, 4), (6, 7)]
    assert audio.segments(np.zeros(5)) == []


def test_damage_is_told():
    with pytest.raises(ValueError):
        audio.samples_of(b"RIFF" + b"\0" * 60)


def test_round_trip(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "é" * 100, 0), (4, "x" * 64, 0), (5, "loud " * 3000 + "\x00" * 9000 + "zz" * 4000, 0), (5, "x" * 64, 0)], "doc_id long, text string, n_bytes int")
    rows = audio.features(audio.store(docs)).collect()
    assert len(rows) == 6
    texts = {(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()}
    for r in rows:
        own = [t for d, t in texts if d == r["doc_id"] and len(t) == r["n_bytes"]]
        pay = own[0] + b"\0" * (max(64, -(-len(own[0]) // 64) * 64) - len(own[0]))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        t = audio.from_ipc(bytes(r["tensors"]))
        assert t.schema.field("log_mel").type == audio.TENSOR and t.num_rows == r["segments"]
        for a, b in zip(t["start_ms"].to_pylist(), t["stop_ms"].to_pylist(), strict=True):
            assert 0 <= a < b
    long = next(r for r in rows if r["n_bytes"] == 32000)
    assert long["segments"] >= 1
    assert audio.features(audio.store(docs.limit(0))).collect() == []
    q = audio.op3_audio(spark, sf_dir).collect()
    by = {}
    for r in q:
        assert by.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]


def test_features_by_brute_force(spark):
    r = np.random.default_rng(5)
    tone = np.sin(np.arange(6000) * 0.3) * np.repeat([1, 60, 2, 90, 1, 40], 1000)
    x = np.clip(128 + tone + r.normal(size=6000), 0, 255).astype(np.uint8)
    # frames by a plain sum over the filtered samples, energies by a plain Fourier sum
    y = audio.resample((x.astype(np.float32) - 128) / 128).astype(float)
    n = max(1, -(-(len(y) - audio.WIN) // audio.HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * audio.HOP + audio.WIN - len(y))])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.WIN // 2 + 1), np.arange(audio.WIN)) / audio.WIN)
    window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * k / audio.WIN) for k in range(audio.WIN)])
    m = np.array([np.log10((np.abs(turn @ (y[k * audio.HOP : k * audio.HOP + audio.WIN] * window)) ** 2) @ audio._MEL + 1e-6) for k in range(n)])
    got = audio.log_mel(x)
    assert got.shape == m.shape and np.abs(got - m).max() < 0.5 / 16 + 1e-3
    # segments by a state that turns on and off
    loud, on, want, start = got.mean(1), False, [], 0
    low, high = loud.min(), loud.max()
    for k, v in enumerate(loud):
        if not on and v >= low + audio.HIGH * (high - low):
            on, start = True, k
        elif on and v < low + audio.LOW * (high - low):
            on = False
            want.append((start, k))
    want += [(start, len(loud))] if on else []
    assert len(want) >= 2 and audio.segments(loud) == want
    spans, t, frames = audio.tensors(x)
    assert frames == n and t.shape == (len(want), audio.SLICES, audio.MELS)
    for (a, b), own in zip(want, t):
        for k in range(audio.SLICES):
            lo = a + (b - a) * k // audio.SLICES
            hi = max(lo + 1, a + (b - a) * (k + 1) // audio.SLICES)
            assert np.abs(own[k] - got[lo:hi].mean(0)).max() <= 0.5 / 16 + 1e-4
    table = audio.store_features(audio.store(spark.createDataFrame([(1, "ab" * 9000 + "z" * 9000)], "doc_id long, text string")))
    row = table.first()
    assert audio.from_ipc(bytes(row["tensors"])).num_rows == row["segments"] and "file" in table.inputFiles()[0]
