"""Operator 2, media columns: audio features of stored clips.

A clip is WAV (RIFF, PCM, mono, 8-bit unsigned). Features: polyphase resampling to a third of the rate,
overlapped frames, log energies of triangular mel filters, and segments of frames by an energy threshold with
hysteresis (a segment opens above HIGH and lasts until the energy falls below LOW). The log-mel frames are
cut into tensors of one fixed shape, TILE x MELS (Arrow's fixed_shape_tensor), each with its time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._common import extended, map_arrow, scratch, stored

RATE = 48_000
UP, DOWN = 1, 3
FRAME, HOP = 256, 128
MELS, TILE = 24, 8
HIGH, LOW = 1.0, 0.25  # decibels above the clip's median frame energy
UNIT = 192
#: Samples resampled and framed at once.
BLOCK = 1 << 20


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file; an odd number of samples gets the format's pad byte."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def read_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit PCM file; chunks other than fmt and data are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def low_pass(up: int, down: int, half: int = 4) -> np.ndarray:
    """Windowed sinc with cut-off at the lower of both Nyquist rates, ``up`` in sum."""
    widest = max(up, down)
    n = np.arange(-half * widest, half * widest + 1)
    h = np.sinc(n / widest) * np.hamming(len(n))
    return h * up / h.sum()


_TAPS = low_pass(UP, DOWN)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: np.ndarray | None = None) -> np.ndarray:
    """Polyphase: output m is the sum over taps of the phase (m * down) % up, ceil(n * up / down) outputs.

    The signal is silent (0) beyond its ends. Only the products that an output needs are formed.
    """
    h = low_pass(up, down) if taps is None else taps
    half = len(h) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n)
    reach = half // up + 1
    padded = np.concatenate((np.zeros(reach), x, np.zeros(reach + down)))
    for phase in range(up):  # outputs whose position falls on this phase
        m = np.arange(phase, n, up)
        position = m * down
        centre = position // up
        sub = position[0] % up if len(m) else 0
        step = down  # successive outputs of a phase are ``down`` inputs apart
        for k in range(-reach, reach + 1):
            tap = half + sub - k * up
            if 0 <= tap < len(h) and len(m):
                first = centre[0] + k + reach
                out[phase::up] += h[tap] * padded[first : first + step * len(m) : step][: len(m)]
    return out


def mel_filters(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """(bins, mels) triangles, evenly spaced on the mel scale up to the Nyquist rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_WINDOW = np.hanning(FRAME)
_FILTERS = mel_filters(RATE * UP // DOWN)


def frames_of(samples: np.ndarray) -> np.ndarray:
    """Frames of FRAME samples, HOP apart, the last one filled up with zeros; one at least."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1) if len(samples) > FRAME else 1
    padded = np.zeros((n - 1) * HOP + FRAME)
    padded[: len(samples)] = samples
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(decibels of each frame's mel bands as int16 hundredths, decibels of each frame's energy)."""
    mel, energy = [], []
    frames = frames_of(samples)
    for at in range(0, len(frames), 4096):
        part = frames[at : at + 4096]
        power = np.abs(np.fft.rfft(part * _WINDOW, axis=1)) ** 2
        mel.append(np.round(1000 * np.log10(power @ _FILTERS + 1e-6)).astype(np.int16))
        energy.append(np.round(10 * np.log10((part**2).mean(axis=1) + 1e-9), 3))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """[first, last) frames of the segments: opened at ``high`` over the median, held down to ``low``."""
    level = energy - np.median(energy)
    state = np.where(level >= high, 1, np.where(level < low, -1, 0))
    known = np.flatnonzero(state)
    on = np.zeros(len(level) + 2, bool)
    if len(known):
        last = np.searchsorted(known, np.arange(len(level)), "right") - 1
        on[1:-1] = (last >= 0) & (state[known[np.maximum(last, 0)]] > 0)
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(media: bytes) -> dict:
    """Tensors, their time spans, and segments (both in milliseconds) of one clip."""
    rate, payload = read_wav(media)
    out_rate = rate * UP / DOWN
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    edge = 3 * (len(_TAPS) // 2)  # blocks overlap by more than the filter reaches, a whole number of outputs
    parts = []
    for at in range(0, max(1, len(x)), BLOCK * DOWN):
        low, top = max(0, at - edge * DOWN), min(len(x), at + BLOCK * DOWN + edge * DOWN)
        y = resample(x[low:top], taps=_TAPS)
        skip = (at - low) * UP // DOWN
        parts.append(y[skip : skip + BLOCK * UP] if top < len(x) else y[skip:])
    mel, energy = log_mel(np.concatenate(parts))
    n = -(-len(mel) // TILE)
    tiles = np.full((n * TILE, MELS), np.int16(-6000))
    tiles[: len(mel)] = mel
    ms = lambda frame: int(round(1000 * frame * HOP / out_rate))
    spans = [(ms(i * TILE), ms(min(len(mel), (i + 1) * TILE))) for i in range(n)]
    return {"tensors": tiles.reshape(n, TILE * MELS), "frames": len(mel), "spans": spans, "segments": [(ms(a), ms(b)) for a, b in segments(energy)]}


def tensor_array(rows: np.ndarray) -> pa.ExtensionArray:
    """Rows of TILE * MELS values as Arrow's fixed-shape tensors."""
    kind = pa.fixed_shape_tensor(pa.int16(), (TILE, MELS), dim_names=["frame", "mel"])
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1), pa.int16()), TILE * MELS))


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, filled up with spaces to a positive multiple of UNIT, as a clip.

    Null text is the empty text (one unit of spaces). Further columns are dropped, repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                raw = b.column("text").slice(at, 256).cast(pa.binary()).to_pylist()
                raw = [x or b"" for x in raw]
                media = [wav(x + b" " * (-len(x) % UNIT or (0 if x else UNIT))) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, 256).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, media binary")


def tensors_ipc(found: dict) -> bytes:
    """A clip's ``features`` as an Arrow IPC stream of (tensor: fixed_shape_tensor, start_ms, end_ms)."""
    table = pa.table({"tensor": tensor_array(found["tensors"]), "start_ms": [s for s, _ in found["spans"]], "end_ms": [e for _, e in found["spans"]]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(tiles x TILE x MELS values, their time spans) of a stream that ``tensors_ipc`` wrote."""
    table = pa.ipc.open_stream(stream).read_all()
    tensor = table.column("tensor").combine_chunks()
    values = tensor.storage.flatten().to_numpy().reshape(-1, *tensor.type.shape)
    return values, list(zip(table.column("start_ms").to_pylist(), table.column("end_ms").to_pylist(), strict=True))


_SPAN = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])


def with_features(clips: DataFrame) -> DataFrame:
    """``clips`` without ``media`` and with its features, a row per clip (clashing columns are replaced).

    tensors: an Arrow IPC stream of fixed-shape tensors (TILE x MELS int16 hundredths of a decibel) with start_ms and
    end_ms, the last one filled up with the floor; n_frames; segments: array of (start_ms, end_ms). Null media: null
    features. Repeated rows get equal features; an empty table stays empty.
    """
    added = ("tensors", "n_frames", "segments")
    media = scratch(clips, "_media")
    clips_ = clips.drop(*[c for c in clips.columns if c.lower() in added]).withColumn(media, F.col("media")).drop("media")
    names = [*[c for c in clips_.columns if c != media], *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [None if x is None else features(x) for x in part.column(media).to_pylist()]
                each = lambda f: [None if x is None else f(x) for x in found]  # noqa: B023, E731
                cuts = each(lambda x: [{"start_ms": s, "end_ms": e} for s, e in x["segments"]])
                kept = [part.column(i) for i, f in enumerate(part.schema) if f.name != media]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(each(tensors_ipc), pa.binary()), pa.array(each(lambda x: x["frames"]), pa.int64()), pa.array(cuts, pa.list_(_SPAN))], names)

    schema = extended(clips_.drop(media), "tensors binary, n_frames bigint, segments array<struct<start_ms:bigint,end_ms:bigint>>")
    return map_arrow(clips_, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Digests of each clip as it is read back, and of its features as these are read back."""
    clips = stored(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    named = clips.select(F.col("doc_id"), F.col("n_bytes"), F.col("media"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("media").alias("payload"))

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        for b in batches:
            read = [read_wav(x.as_py())[1] for x in b.column("payload")]
            values = ([len(x) for x in read], [hashlib.sha256(x).hexdigest() for x in read], [zlib.crc32(x[-16:]) for x in read])
            kept = [c for c in b.schema.names if c != "payload"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(v, k) for v, (_, k) in zip(values, kinds, strict=True)]], [*kept, *[k for k, _ in kinds]])

    digested = map_arrow(named, payload, extended(named.drop("payload"), "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"))
    tensors = stored(with_features(digested), "tensors")

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stream, frames, cuts in zip(b.column("tensors"), b.column("n_frames").to_pylist(), b.column("segments").to_pylist(), strict=True):
                values, spans = read_tensors(stream.as_py())
                out.append(f"{'x'.join(map(str, values.shape))}|{frames}|{spans[-1][1]}|{hashlib.md5(values.tobytes()).hexdigest()}|{','.join(f'{x["start_ms"]}-{x["end_ms"]}' for x in cuts)}")
            kept = b.schema.names[:-3]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.string())], [*kept, "feature"])

    tensors = tensors.select(*[c for c in tensors.columns if c not in ("tensors", "n_frames", "segments")], "tensors", "n_frames", "segments")
    schema = extended(tensors.drop("tensors", "n_frames", "segments"), "feature string")
    return map_arrow(tensors, feature, schema).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
