"""Media columns: audio kept as WAV, its log-mel features as fixed-shape tensors with time spans.

Audio is resampled by a polyphase filter, cut into overlapped frames for a log-mel filterbank, and segmented by frame
energy with hysteresis: a segment begins where the energy reaches the upper threshold and lasts until it falls below
the lower one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, sections, small_batches

#: Fixed value: the size of a RIFF/WAVE header with one format chunk.
HEADER = 44


@dataclass(frozen=True)
class Settings:
    """rate: of the stored samples; up / down: resampling; frame, hop, fft: samples after it; bands: mel filters;
    frames: of a tensor; taps: of each phase of the filter; upper, lower: thresholds in dB above the quietest frame
    of the recording, as shares of its range; block: stored samples resampled as one, a multiple of down."""

    rate: int = 24_000
    up: int = 2
    down: int = 3
    frame: int = 400
    hop: int = 160
    fft: int = 512
    bands: int = 40
    frames: int = 16
    taps: int = 16
    upper: float = 0.6
    lower: float = 0.4
    block: int = 192

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


# -- storing -------------------------------------------------------------------------------------------------------


def padded(text: Column, unit: int = 192) -> Column:
    """A text's UTF-8 bytes, spaces appended up to a positive multiple of unit; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    n = F.octet_length(text)
    fill = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    return F.encode(F.concat(text, F.repeat(F.lit(" "), fill)), "UTF-8")


def _le(value: Column, size: int) -> Column:
    """An integer as little-endian bytes, natively."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)]))


def wav(payload: Column, rate: int) -> Column:
    """A payload of even length as the samples of a mono 8-bit PCM WAV file."""
    n = F.octet_length(payload)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(F.lit(b"RIFF"), _le(n + HEADER - 8, 4), F.lit(b"WAVE"), F.lit(form), F.lit(b"data"), _le(n, 4), payload)


def read_wav(stored: bytes) -> tuple[int, np.ndarray]:
    """The rate and the 8-bit samples of a mono WAV file, found by its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, np.frombuffer(stored, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


# -- features ------------------------------------------------------------------------------------------------------


class Features:
    """The features of one setting. A recording's depend on its samples alone: it is worked on in blocks of a fixed
    shape, so that equal recordings give equal bits whatever stands beside them."""

    #: Blocks of `block` samples and frames that are worked on at once.
    BLOCKS, FRAMES = 16, 16

    def __init__(self, s: Settings) -> None:
        self.s = s
        # windowed-sinc low pass at the lower of both rates, in the rate of rate * up
        half = s.taps * s.up // 2
        t = np.arange(-half, half + 1)
        cut = 1 / max(s.up, s.down)
        self.filter = (np.sinc(t * cut) * cut * s.up * (0.54 + 0.46 * np.cos(np.pi * t / (half + 1)))).astype(np.float64)
        self.halo = half // s.up + 1
        # the polyphase branches of one block, as a banded matrix: input samples (with halo) to output samples
        n_out = s.block * s.up // s.down
        self.branches = np.zeros((s.block + 2 * self.halo, n_out))
        for j in range(n_out):
            centre = j * s.down  # in the rate of rate * up
            for i in range(-self.halo, s.block + self.halo):
                k = centre - i * s.up
                if abs(k) <= half:
                    self.branches[i + self.halo, j] = self.filter[k + half]
        self.branches = self.branches.astype(np.float32)
        self.window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s.frame) / s.frame)).astype(np.float32)
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(s.out_rate / 2), s.bands + 2) / 2595) - 1)
        bins = np.arange(s.fft // 2 + 1) * s.out_rate / s.fft
        rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
        fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
        self.mel = np.maximum(0, np.minimum(rise, fall)).astype(np.float32)

    def resample(self, samples: np.ndarray) -> np.ndarray:
        """8-bit samples (unsigned, silence at 128) at the stored rate to float32 in -1..1 at the target rate."""
        s, n = self.s, len(samples)
        blocks = -(-n // s.block)
        whole = -(-blocks // self.BLOCKS) * self.BLOCKS
        x = np.zeros(whole * s.block + 2 * self.halo, np.float32)
        x[self.halo : self.halo + n] = samples
        x[self.halo : self.halo + n] -= 128
        x /= 128
        wide = np.lib.stride_tricks.sliding_window_view(x, s.block + 2 * self.halo)[:: s.block]
        out = np.concatenate([wide[i : i + self.BLOCKS] @ self.branches for i in range(0, whole, self.BLOCKS)])
        return out.reshape(-1)[: -(-n * s.up // s.down)]

    def log_mel(self, audio: np.ndarray) -> np.ndarray:
        """Frames x bands, as hundredths of a decibel (int16); the audio is padded by silence to a whole last frame."""
        s = self.s
        n = 1 + max(0, -(-(len(audio) - s.frame) // s.hop))
        whole = -(-n // self.FRAMES) * self.FRAMES
        x = np.zeros((whole - 1) * s.hop + s.frame, np.float32)
        x[: len(audio)] = audio
        frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop]
        out = np.empty((whole, s.bands), np.int16)
        for i in range(0, whole, self.FRAMES):
            spectrum = np.fft.rfft(frames[i : i + self.FRAMES] * self.window, s.fft)
            power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
            out[i : i + self.FRAMES] = np.rint(1000 * np.log10(power @ self.mel + 1e-10))
        return out[:n]

    def segments(self, mel: np.ndarray) -> np.ndarray:
        """Begin and end frames (end exclusive) of the segments, by hysteresis on the mean band level of each frame."""
        s = self.s
        level = mel.astype(np.int64).sum(1)
        low, high = level.min(), level.max()
        if low == high:
            return np.zeros((0, 2), np.int64)
        on, off = level >= low + s.upper * (high - low), level < low + s.lower * (high - low)
        # the last frame that decided, for each frame; it is on if that one was
        last = np.maximum.accumulate(np.where(on | off, np.arange(len(level)), -1))
        active = np.where(last >= 0, on[np.maximum(last, 0)], False)
        edge = np.diff(np.concatenate([[0], active.astype(np.int8), [0]]))
        return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)

    def tensors(self, mel: np.ndarray) -> np.ndarray:
        """Frames x bands as tensors x frames x bands, the last filled up by the lowest value."""
        s = self.s
        n = -(-len(mel) // s.frames)
        out = np.full((n * s.frames, s.bands), np.iinfo(np.int16).min, np.int16)
        out[: len(mel)] = mel
        return out.reshape(n, s.frames, s.bands)


def _features(s: Settings) -> Features:
    return held(s, lambda: Features(s))


def features(media: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """For each row: doc_id, the carried columns, payload (the stored samples as read back), n_frames, tensors (an
    Arrow stream of fixed-shape tensors, each with its time span; see tensor_table()) and segments
    (array<struct<begin, end>> in seconds).

    A null recording gives a row of nulls; an empty one has a frame of silence and no segments. Rows are independent:
    repeated rows give equal rows, other columns are ignored, an empty table gives none. A long recording is worked on
    in blocks, but its own samples and tensors are in memory together.
    """
    span = "array<struct<begin: double, end: double>>"
    carry = carry or []

    def spans(each: list[np.ndarray | None]) -> pa.Array:
        flat = np.concatenate([np.zeros((0, 2)), *[x for x in each if x is not None]])
        offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in each])]).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets), cells, mask=pa.array([x is None for x in each]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _features(settings)
        for batch in batches:
            sizes = [x or 0 for x in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for part in sections(sizes, 4_000_000):
                payload, count, tensor, cut = [], [], [], []
                for stored in batch.column(1)[part.start : part.stop]:
                    raw = stored.as_py()
                    if raw is None:
                        for x in (payload, count, tensor, cut):
                            x.append(None)
                        continue
                    rate, samples = read_wav(raw)
                    if rate != settings.rate:
                        raise ValueError(f"samples of {rate} Hz, not {settings.rate}")
                    mel = f.log_mel(f.resample(samples))
                    step, n = settings.hop / settings.out_rate, len(mel)
                    begin = np.arange(0, n, settings.frames)
                    payload.append(samples.tobytes())
                    count.append(n)
                    tensor.append(tensor_stream(f.tensors(mel), np.stack([begin, np.minimum(begin + settings.frames, n)], 1) * step, settings))
                    cut.append(f.segments(mel) * step)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], *[c[part.start : part.stop] for c in batch.columns[2:]], pa.array(payload, pa.binary()), pa.array(count, pa.int64()), pa.array(tensor, pa.binary()), spans(cut)],
                    ["doc_id", *carry, "payload", "n_frames", "tensors", "segments"],
                )

    small_batches(media.sparkSession)
    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("__media"), *[F.col(c) for c in carry])
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long{kept}, payload binary, n_frames long, tensors binary, segments {span}")


def tensor_schema(s: Settings) -> pa.Schema:
    """tensor: int16 of shape (frames, bands), hundredths of a decibel; begin, end: its span in seconds."""
    kind = pa.fixed_shape_tensor(pa.int16(), (s.frames, s.bands), dim_names=("frame", "band"))
    return pa.schema([("tensor", kind), ("begin", pa.float64()), ("end", pa.float64())])


def tensor_stream(tensors: np.ndarray, spans: np.ndarray, s: Settings) -> bytes:
    """A recording's tensors and their spans as an Arrow stream."""
    schema = held(("tensors", s), lambda: tensor_schema(s), beside=True)
    cells = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), s.frames * s.bands)
    columns = [pa.ExtensionArray.from_storage(schema.field(0).type, cells), pa.array(np.ascontiguousarray(spans[:, 0])), pa.array(np.ascontiguousarray(spans[:, 1]))]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def tensor_table(stream: bytes) -> pa.Table:
    """The stored tensors and spans of a recording."""
    return pa.ipc.open_stream(stream).read_all()


def op2_audio(spark, sf_dir: str) -> DataFrame:
    s = Settings()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), wav(padded(F.col("text"), s.block), s.rate).alias("media"))
    media = media.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    found = features(media, s, carry=["n_bytes", "media_bytes", "media_sha256"])
    hundredths = lambda c: F.round(c * 100).cast("long").cast("string")
    cuts = F.array_join(F.transform("segments", lambda x: F.concat(hundredths(x["begin"]), F.lit("-"), hundredths(x["end"]))), ",")
    feature = F.concat_ws(";", F.col("n_frames").cast("string"), F.size("segments").cast("string"), F.sha2("tensors", 256), F.sha2(cuts, 256))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )
