"""Telephony audio: mu-law and A-law samples and IMA ADPCM blocks in WAV files, decoded with numpy."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixfield.llm.batches import slices

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
RATE = 8000
#: Payloads are filled up with FILL to a multiple of so many bytes, which is also the size of an ADPCM block.
BLOCK = 576
FILL = 255


def mu_law_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    exponent = (code >> 4) & 7
    size = ((code & 15) << 4) + 8 + np.where(exponent > 0, 256, 0) << np.maximum(exponent - 1, 0)
    return np.where(code & 128, size, -size).astype(np.int16)


def step_sizes() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: fixed values of the format."""
    # fmt: off
    steps = [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
    # fmt: on
    return np.array(steps, np.int32)


#: Fixed values of IMA ADPCM: the change of the step index for the low three bits of a code.
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, one row for each row of bytes.

    A block begins with its first sample (little-endian 16 bits), the step index and a reserved byte; each
    further byte holds two codes, the low one first. All blocks go through a step together.
    """
    steps = step_sizes()
    head = blocks[:, :4].astype(np.int32)
    sample = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = sample
    # the difference of a code at each step index, so that a step is two lookups and two clips
    low = np.arange(16)[None, :]
    size = steps[:, None]
    table = (size >> 3) + np.where(low & 4, size, 0) + np.where(low & 2, size >> 1, 0) + np.where(low & 1, size >> 2, 0)
    table = np.where(low & 8, -table, table).astype(np.int32).ravel()
    change = np.tile(INDEX_CHANGES, 2)
    for i, code in enumerate(codes, 1):
        sample = np.clip(sample + table[index * 16 + code], -32768, 32767)
        index = np.clip(index + change[code], 0, 88)
        out[i] = sample
    return out.T


def encode_adpcm(samples: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Mono IMA ADPCM blocks of rows of samples, as many samples in a row as ``decode_adpcm`` gives."""
    steps = step_sizes()
    samples = samples.astype(np.int32)
    sample, index = samples[:, 0].copy(), np.zeros(len(samples), np.int32)
    out = np.zeros((len(samples), block), np.uint8)
    out[:, 0], out[:, 1] = sample & 0xFF, (sample >> 8) & 0xFF
    for i in range(1, samples.shape[1]):
        step = steps[index]
        away = samples[:, i] - sample
        code = np.minimum(np.abs(away) * 4 // step, 7)
        moved = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        sample = np.clip(sample + np.where(away < 0, -moved, moved), -32768, 32767)
        index = np.clip(index + INDEX_CHANGES[code], 0, 88)
        nibble = (code | np.where(away < 0, 8, 0)).astype(np.uint8)
        out[:, 4 + (i - 1) // 2] |= nibble << (4 * ((i - 1) % 2))
    return out


def resample(samples: np.ndarray, up: int = 2) -> np.ndarray:
    """16-bit samples at ``up`` times the rate, on straight lines between neighbours; the last value is held."""
    if not len(samples):
        return samples.astype(np.int16)
    wide = samples.astype(np.int32)
    after = np.append(wide[1:], wide[-1:])
    return ((wide[:, None] * np.arange(up, 0, -1) + after[:, None] * np.arange(up)) // up).astype(np.int16).ravel()


def wav(data: bytes, kind: int, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file with 8-bit G.711 samples, 16-bit PCM samples or ADPCM blocks of ``block`` bytes."""
    align = {PCM: 2, IMA_ADPCM: block}.get(kind, 1)
    bits = {PCM: 16, IMA_ADPCM: 4}.get(kind, 8)
    per_block = 2 * (block - 4) + 1 if kind == IMA_ADPCM else 1
    extra = struct.pack("<HH", 2, per_block) if kind == IMA_ADPCM else b"" if kind == PCM else b"\0\0"
    layout = struct.pack("<HHIIHH", kind, 1, rate, rate * align // per_block, align, bits) + extra
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, len(data) // align * per_block)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(layout)) + layout + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and data of a WAV file; ``ValueError`` if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, align = 12, None, 0, 1
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data" and kind is not None:
            return kind, rate, align, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without format or data")


def samples_of(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a WAV file of any of the four formats."""
    kind, rate, align, data = read_wav(media)
    if kind == PCM:
        return rate, np.frombuffer(data, "<i2")
    codes = np.frombuffer(data, np.uint8)
    if kind == IMA_ADPCM:
        return rate, decode_adpcm(codes[: len(codes) // align * align].reshape(-1, align)).ravel()
    return rate, {MU_LAW: mu_law_table, A_LAW: a_law_table}[kind]()[codes]


def store(docs: DataFrame, kind: int = MU_LAW) -> DataFrame:
    """The UTF-8 bytes of each whole text of ``docs(doc_id, text)`` as the 8-bit samples of a WAV file.

    A payload is filled up with bytes 255 to a positive multiple of 576; a null text is an empty one. Any byte is a
    valid mu-law or A-law code and, taken 576 at a time, an ADPCM block, so the file keeps it as it is. Returns
    ``doc_id, n_bytes, media``, one row for each of ``docs``; a doc_id may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            media, sizes = [], []
            for text in batch.column(1).to_pylist():
                sizes.append(len(text))
                media.append(wav(text + bytes([FILL]) * (-len(text) % BLOCK if text else BLOCK), kind, block=BLOCK if kind == IMA_ADPCM else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(files: DataFrame) -> DataFrame:
    """Reads ``files(doc_id, n_bytes, media)`` of 8-bit WAV files back.

    ``payload`` is the file's data, ``pcm`` the decoded samples at twice the rate (16 bits, little-endian), and ``feature`` the loudness
    (root of the mean square) of the data read as mu-law, as A-law and as ADPCM blocks, the number of sign changes and the
    CRC-32 of ``pcm``. All depend on the file alone. A null file has null results.
    """
    mu, a = mu_law_table(), a_law_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in slices(batches, 2):
            read = [None if x is None else read_wav(x) for x in batch.column(2).to_pylist()]
            data = [b"" if x is None else x[3] for x in read]
            blocks = [len(x) // BLOCK for x in data]
            codes = np.frombuffer(b"".join(x[: n * BLOCK] for x, n in zip(data, blocks, strict=True)), np.uint8).reshape(-1, BLOCK)
            power = (decode_adpcm(codes).astype(np.float64) ** 2).mean(axis=1) if len(codes) else np.zeros(0)
            pcm, features, at = [], [], 0
            for x, own, n in zip(read, data, blocks, strict=True):
                if x is None:
                    pcm.append(None), features.append(None)
                    continue
                own = np.frombuffer(own, np.uint8)
                as_mu, as_a = mu[own], a[own]
                samples = {MU_LAW: as_mu, A_LAW: as_a}[x[0]]
                pcm.append(resample(samples).astype("<i2").tobytes())
                loud = [np.sqrt(np.square(s, dtype=np.float64).mean()) if len(s) else 0.0 for s in (as_mu, as_a)]
                loud.append(np.sqrt(power[at : at + n].mean()) if n else 0.0)
                at += n
                negative = samples < 0
                turns = int(np.count_nonzero(negative[1:] != negative[:-1]))
                features.append(";".join([*(f"{v:.2f}" for v in loud), str(turns), f"{crc32(pcm[-1]):08x}"]))
            payloads = [None if x is None else x[3] for x in read]
            columns = [*batch.columns, pa.array(payloads, pa.binary()), pa.array(pcm, pa.binary()), pa.array(features, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "payload", "pcm", "feature"])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, pcm binary, feature string")
