"""Media columns: telephony audio.

mu-law and A-law bytes expand through 256-entry tables, IMA ADPCM blocks are
decoded with numpy over all blocks at once, and PCM is resampled linearly in
integers. ``store_media`` keeps payloads losslessly as mu-law WAVE files in a
binary column; ``read_media`` decodes the stored bytes again.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table, text_or_empty

#: Bytes of a payload come in frames of this many.
FRAME = 192
PCM_TAG, ALAW_TAG, MULAW_TAG, ADPCM_TAG = 1, 6, 7, 0x11
TELEPHONE_HZ = 8000


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte: inverted bits of sign, exponent, mantissa; bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte: even bits inverted, sign set for positive values."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


#: Fixed values of IMA ADPCM: change of the step index by nibble.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


#: Fixed values of IMA ADPCM: the step sizes, each about 1.1 times the one before.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)


def decode_adpcm(data: bytes, block_align: int) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks: 4 header bytes (sample, index), then two samples a byte.

    All blocks advance together, one nibble a step. A last short block is
    padded with zero nibbles and cut to its own length.
    """
    if block_align < 4:
        raise ValueError("a block has 4 bytes at least")
    n_blocks = -(-len(data) // block_align)
    if not n_blocks:
        return np.zeros(0, np.int16)
    raw = np.frombuffer(data.ljust(n_blocks * block_align, b"\0"), np.uint8).reshape(n_blocks, block_align)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    body = raw[:, 4:]
    nibbles = np.empty((n_blocks, body.shape[1] * 2), np.uint8)
    nibbles[:, 0::2], nibbles[:, 1::2] = body & 15, body >> 4
    out = np.empty((n_blocks, nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        nib, step = nibbles[:, k].astype(np.int32), STEPS[index]
        diff = (step >> 3) + (step >> 2) * (nib & 1) + (step >> 1) * ((nib >> 1) & 1) + step * ((nib >> 2) & 1)
        value = np.clip(np.where(nib & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[nib], 0, 88)
        out[:, k + 1] = value
    flat = out.ravel()
    short = n_blocks * block_align - len(data)
    if short:
        flat = flat[: len(flat) - (out.shape[1] if short > block_align - 4 else 2 * short)]
    return flat


def resample(pcm: np.ndarray, from_hz: int, to_hz: int) -> np.ndarray:
    """Linear interpolation in 64-bit integers; ``floor(n * to / from)`` samples, the last one held."""
    n = len(pcm) * to_hz // from_hz
    if not n or from_hz == to_hz:
        return pcm[:n].astype(np.int16)
    at = np.arange(n, dtype=np.int64) * from_hz
    left, part = at // to_hz, at % to_hz
    x = pcm.astype(np.int64)
    right = np.minimum(left + 1, len(x) - 1)
    return ((x[left] * (to_hz - part) + x[right] * part) // to_hz).astype(np.int16)


#: Samples that are decoded and resampled at once.
PIECE = 1 << 18


def pcm_pieces(tag: int, payload: bytes, block_align: int = 1) -> Iterator[np.ndarray]:
    """PCM of ``payload`` in order, about ``PIECE`` samples at once."""
    step = max(1, PIECE // (2 * block_align)) * block_align if tag == ADPCM_TAG else PIECE
    for k in range(0, len(payload), step):
        yield to_pcm(tag, payload[k : k + step], block_align)


def resample_pieces(pieces: Iterator[np.ndarray], from_hz: int, to_hz: int) -> Iterator[np.ndarray]:
    """``resample`` of the pieces as one signal, holding one piece and what the next samples need of the one before."""
    if from_hz == to_hz:
        yield from pieces
        return
    held, base, made = np.zeros(0, np.int64), 0, 0  # held starts at sample ``base``; ``made`` samples are out

    def upto(n: int) -> np.ndarray:
        at = np.arange(made, n, dtype=np.int64) * from_hz
        left, part = at // to_hz - base, at % to_hz
        right = np.minimum(left + 1, len(held) - 1)
        return ((held[left] * (to_hz - part) + held[right] * part) // to_hz).astype(np.int16)

    for piece in pieces:
        held = np.concatenate([held, piece.astype(np.int64)])
        last = base + len(held) - 1
        # those whose right neighbour is here and that the samples so far are long enough for
        n = min(-(-last * to_hz // from_hz), (last + 1) * to_hz // from_hz)
        if n > made:
            yield upto(n)
            made = n
            drop = min(made * from_hz // to_hz, last) - base
            held, base = held[drop:], base + drop
    n = (base + len(held)) * to_hz // from_hz
    if n > made:
        yield upto(n)


def wave(payload: bytes, tag: int = MULAW_TAG, hz: int = TELEPHONE_HZ, block_align: int = 1, bits: int = 8) -> bytes:
    """A mono WAVE file around ``payload``; an odd payload gets the format's pad byte."""
    fmt = struct.pack("<HHIIHHH", tag, 1, hz, hz * block_align, block_align, bits, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, sample rate, block size and payload of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, hz, align = 12, 0, 0, 1
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, hz, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif kind == b"data":
            return tag, hz, align, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def to_pcm(tag: int, payload: bytes, block_align: int = 1) -> np.ndarray:
    if tag == MULAW_TAG:
        return mulaw_table()[np.frombuffer(payload, np.uint8)]
    if tag == ALAW_TAG:
        return alaw_table()[np.frombuffer(payload, np.uint8)]
    if tag == ADPCM_TAG:
        return decode_adpcm(payload, block_align)
    if tag == PCM_TAG:
        return np.frombuffer(payload[: len(payload) & ~1], "<i2")
    raise ValueError(f"format {tag} is not telephony audio")


def decode_media(df: DataFrame, to_hz: int = 16_000, media_col: str = "media") -> DataFrame:
    """``df`` with ``pcm`` (little-endian 16-bit samples at ``to_hz``) and ``pcm_hz``; null media give null."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            pcm = []
            for m in b[media_col]:
                if m is None:
                    pcm.append(None)
                    continue
                tag, hz, align, payload = unwave(m)
                pcm.append(b"".join(x.astype("<i2").tobytes() for x in resample_pieces(pcm_pieces(tag, payload, align), hz, to_hz)))
            yield {**b, "pcm": pcm, "pcm_hz": [to_hz] * len(pcm)}

    base = df.drop("pcm", "pcm_hz")
    return arrow_map(base, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", pcm binary, pcm_hz int")


def pad(raw: bytes, frame: int = FRAME) -> bytes:
    """Spaces up to a positive multiple of ``frame``."""
    return raw.ljust(max(1, -(-len(raw) // frame)) * frame, b" ")


def store_media(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text's UTF-8 as a mu-law WAVE file.

    Null and empty texts give one frame of spaces; rows that repeat are kept;
    a text of any length is one file, held a few times in memory (its limit is
    the format's 4 GB); extra columns are not read, whatever their names; an
    empty table gives no rows.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            raw = [t.encode() for t in b["text"]]
            yield {"doc_id": b["doc_id"], "n_bytes": [len(r) for r in raw], "media": [wave(pad(r, frame)) for r in raw]}

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, n_bytes long, media binary")


def feature(payload: bytes, tag: int, hz: int, to_hz: int = 16_000, block_align: int = 1) -> str:
    """Loudness, peak, sign changes and a checksum of the resampled PCM, summed up piece by piece."""
    n = squares = peak = changes = crc = 0
    negative: bool | None = None
    for pcm in resample_pieces(pcm_pieces(tag, payload, block_align), hz, to_hz):
        if not len(pcm):
            continue
        x = pcm.astype(np.int64)
        below = x < 0
        changes += int(np.count_nonzero(below[1:] != below[:-1])) + (negative is not None and bool(below[0]) != negative)
        negative = bool(below[-1])
        n += len(x)
        squares += int((x * x).sum())
        peak = max(peak, int(np.abs(x).max()))
        crc = zlib.crc32(pcm.astype("<i2").tobytes(), crc)
    return f"n={n};rms={math.isqrt(squares // max(1, n))};peak={peak};zc={changes};pcm={crc:08x}"


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and the feature of stored media, all from the bytes read back; long media are decoded in pieces."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in b["media"]:
                tag, hz, align, payload = unwave(m)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(m))
                out["media_sha256"].append(hashlib.sha256(m).hexdigest())
                out["feature"].append(feature(payload, tag, hz, block_align=align))
            yield {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], **out}

    return arrow_map(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(store_media(table(spark, sf_dir, "documents")), "media")
    return read_media(stored)
