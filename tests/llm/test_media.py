import hashlib
import zlib

import numpy as np
import pytest

from rawloom.llm import media
from tests.llm import data


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 200_000])
def test_payload_round_trip(n):
    text = np.random.default_rng(n).bytes(n)
    payload = media.payload_of(text)
    assert len(payload) % 576 == 0 and payload[:n] == text and set(payload[n:]) <= {255} and 0 <= len(payload) - max(n, 1) < 576
    assert media.from_wav(media.to_wav(payload)) == payload
    logs, found = media.analyse(payload)
    batch = media.unpack(media.pack(media.tensors(logs)))
    clips = batch.column(0).to_numpy_ndarray()
    assert clips.shape[1:] == (media.CLIP, media.MELS) and (clips.reshape(-1, media.MELS)[: len(logs)] == logs).all()
    assert all(0 <= a < b <= len(logs) for a, b in found) and len(logs) == len(payload) * 2 // 3 // media.HOP - 1


def test_resampling_keeps_a_tone():
    n = 12_000
    tone = np.sin(2 * np.pi * 1000 * np.arange(n) / media.RATE).astype(np.float32)
    out = media.resample(tone)
    peak = np.abs(np.fft.rfft(out)).argmax() * 8000 / len(out)
    assert len(out) == 8000 and abs(peak - 1000) < 2 and 0.9 < np.abs(out[200:-200]).max() < 1.1


def test_resampling_equals_the_direct_sum():
    x = np.random.default_rng(1).normal(size=576).astype(np.float32)
    taps = media.PHASE_TAPS * media.UP
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / media.DOWN) * np.hamming(taps)
    h *= media.UP / h.sum()
    up = np.zeros(len(x) * 2 + 4 * taps)
    up[2 * taps : 2 * taps + 2 * len(x) : 2] = x
    full = np.convolve(up, h)
    got = media.resample(x)
    best = min(np.abs(full[2 * taps + d :: 3][: len(got)][10:-10] - got[10:-10]).max() for d in range(taps))
    assert best < 1e-4


def test_hysteresis():
    energy = np.array([0, 0, 10, 6, 6, 0, 6, 0, 10, 10], float)
    high, low = energy.mean() + media.ON * energy.std(), energy.mean() + media.OFF * energy.std()
    state, want, start = False, [], 0
    for k, e in enumerate([*energy, -100]):
        now = e >= high or (state and e >= low)
        if now and not state:
            start = k
        if state and not now:
            want.append([start, k])
        state = now
    assert media.segments(energy).tolist() == want


def test_digests(spark):
    rows = data.documents()
    found = media.digests(media.audio_features(data.frame(spark, rows, True))).collect()
    by_text = {}
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = media.payload_of(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest() and r["media_bytes"] == 44 + len(payload)
        assert by_text.setdefault(raw, r["feature"]) == r["feature"]
    assert media.digests(media.audio_features(data.empty(spark))).count() == 0
