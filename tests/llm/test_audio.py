import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from murmur.llm import audio

from .helpers import awkward, frame, saved


def test_resampling_is_the_direct_convolution():
    f = audio.Features(audio.Settings())
    s = f.s
    x = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    up = np.zeros(len(x) * s.up + 2 * len(f.filter))
    up[len(f.filter) : len(f.filter) + len(x) * s.up : s.up] = (x.astype(float) - 128) / 128
    half = len(f.filter) // 2
    full = np.convolve(up, f.filter)[len(f.filter) + half :]
    want = full[: len(x) * s.up : s.down]
    got = f.resample(x)
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-5


def test_log_mel_is_the_direct_sum():
    f = audio.Features(audio.Settings())
    s = f.s
    a = np.random.default_rng(2).standard_normal(4000).astype(np.float32) / 4
    got = f.log_mel(a)
    for i in (0, 3, len(got) - 1):
        x = np.zeros(s.frame)
        part = a[i * s.hop : i * s.hop + s.frame]
        x[: len(part)] = part
        power = np.abs(np.fft.rfft(x * f.window, s.fft)) ** 2
        assert np.abs(got[i] - 1000 * np.log10(power @ f.mel + 1e-10)).max() <= 2


def test_hysteresis_by_a_state_machine():
    f = audio.Features(audio.Settings())
    level = np.random.default_rng(3).integers(-9000, 3000, 400).astype(np.int16)
    mel = np.repeat(level[:, None], f.s.bands, 1)
    low, high = int(level.min()) * f.s.bands, int(level.max()) * f.s.bands
    on, runs, active = [], [], False
    for v in level.astype(int) * f.s.bands:
        active = v >= low + f.s.upper * (high - low) or (active and not v < low + f.s.lower * (high - low))
        on.append(active)
    at = 0
    for i, x in enumerate([*on, False]):
        if x and (i == 0 or not on[i - 1]):
            at = i
        if not x and i and on[i - 1]:
            runs.append((at, i))
    assert [tuple(r) for r in f.segments(mel)] == runs


def test_query(spark, tmp_path):
    got = audio.op2_audio(spark, saved(spark, tmp_path)).collect()
    want = []
    for row in awkward():
        raw = (row[1] or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((row[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p) + 44))
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in got) == Counter(want)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    alone = audio.op2_audio(spark, saved(spark, tmp_path, [awkward()[10]])).first()
    assert alone.feature == next(r.feature for r in got if r.doc_id == 10)  # whatever stands beside it
    assert audio.op2_audio(spark, saved(spark, tmp_path, [])).count() == 0


def test_tensors_and_spans(spark):
    s = audio.Settings()
    media = frame(spark).where("doc_id = 10").select("doc_id", audio.wav(audio.padded(F.col("text")), s.rate).alias("media"))
    row = audio.features(media).first()
    t = audio.tensor_table(row.tensors)
    kind = t.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [s.frames, s.bands]
    f = audio.Features(s)
    mel = f.log_mel(f.resample(audio.read_wav(media.first().media)[1]))
    assert np.array_equal(t["tensor"].combine_chunks().to_numpy_ndarray(), f.tensors(mel))
    assert len(t) == -(-row.n_frames // s.frames) and len(mel) == row.n_frames
    assert t["begin"].to_pylist()[0] == 0 and np.allclose(t["begin"].to_pylist()[1:], t["end"].to_pylist()[:-1]) and np.isclose(t["end"].to_pylist()[-1], row.n_frames * s.hop / s.out_rate)
    assert all(a.begin < a.end for a in row.segments)
    none = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert audio.features(none).first().payload is None
