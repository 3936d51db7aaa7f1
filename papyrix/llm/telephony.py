"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

A payload is stored as a WAVE file whose mu-law or A-law samples, or whose ADPCM blocks of 64 bytes, are the payload's bytes,
which loses nothing; reading parses the file, expands it to 16-bit PCM and resamples that. The resampled PCM is stored
without loss by one lifting step (``lift``), as its odd samples are mostly what their neighbours predict. Which format a
payload gets is settled by its crc32 (``tag_of``): one in 64 is ADPCM, of the others odd ones are A-law and even ones mu-law.

Defined results: a null text is empty; an empty text is one block of 64 zero bytes; equal texts give equal values; repeated
rows are stored one by one; a null doc_id stays null; an empty table gives empty tables; other columns of documents are not
read, so their names can't clash. A last ADPCM block that is cut short gives the samples it has, none if its header is cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, OUT_RATE = 8000, 16000
BLOCK = 64  # bytes of an ADPCM block; payloads are padded to a multiple of it
SMALL = {"parquet.compression.codec.zstd.level": 12, "parquet.page.size": 4 << 20}  # how both columns are written
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17  # format tags of WAVE files


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte (ITU-T G.711)."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law byte (ITU-T G.711)."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    step, low = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(step == 0, low + 8, (low + 0x108) << np.maximum(step - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


#: Fixed values of the IMA ADPCM format: index changes by code; step sizes grow by about a tenth from 7 to 32767.
ADPCM_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
ADPCM_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])


def _changes() -> np.ndarray:
    """What each code adds to the sample at each step size: an eighth, and a quarter, a half, a whole by its bits; the top bit is the sign."""
    code, step = np.arange(16), ADPCM_STEPS[:, None]
    change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    return np.where(code & 8, -change, change).astype(np.int32)


ADPCM_CHANGE = _changes()


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """PCM of mono IMA ADPCM: a loop over the codes of a block, each step over all blocks at once."""
    short = len(data) % block
    blocks = np.frombuffer(data + bytes(-len(data) % block), np.uint8).reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code = codes[:, k]
        change = ADPCM_CHANGE[index, code]
        value = np.clip(value + change, -32768, 32767)
        index = np.clip(index + ADPCM_INDEX[code], 0, 88)
        out[:, k + 1] = value
    made = out.reshape(-1)
    missing = codes.shape[1] + 1 - max(0, 2 * (short - 4) + 1) if short else 0
    return made[: len(made) - missing]


def resample(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """Linear interpolation between neighbours, in integers: the same on every machine."""
    if rate == out_rate or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * out_rate // rate
    at = np.arange(n, dtype=np.int64) * rate
    low, part = at // out_rate, at % out_rate
    x = pcm.astype(np.int64)
    return ((x[low] * (out_rate - part) + x[np.minimum(low + 1, len(x) - 1)] * part) // out_rate).astype(np.int16)


def lift(samples: np.ndarray) -> bytes:
    """16-bit samples by one lifting step, the same number of bytes: the even samples, then what each odd one differs from its neighbours' mean."""
    x = samples.astype(np.int32)
    even, odd = x[::2], x[1::2]
    return even.astype("<i2").tobytes() + (odd - _between(even)[: len(odd)]).astype("<i2").tobytes()


def unlift(data: bytes) -> np.ndarray:
    """The samples behind ``lift``."""
    x = np.frombuffer(data, "<i2").astype(np.int32)
    even, rest = x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :]
    out = np.empty(len(x), np.int16)
    out[::2], out[1::2] = even, (rest + _between(even)[: len(rest)]).astype(np.int16)
    return out


def _between(even: np.ndarray) -> np.ndarray:
    return (even + np.append(even[1:], even[-1:])) >> 1


def tag_of(payload: bytes) -> int:
    """The format a payload is stored in, by its crc32."""
    crc = zlib.crc32(payload)
    return ADPCM if crc % 64 == 0 else ALAW if crc % 2 else MULAW


def wave(tag: int, data: bytes, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAVE file."""
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * block, block, bits) + (b"" if tag == PCM else struct.pack("<H", 0))
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(data)) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, sampling rate, block size and sample bytes of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a WAVE file needs fmt and data")
    return form[0], form[2], form[4], data


_mulaw, _alaw = mulaw_table(), alaw_table()


def pcm(media: list[bytes]) -> list[tuple[bytes, int, np.ndarray]]:
    """Payload, rate and 16-bit samples of mu-law, A-law, ADPCM or PCM files; ADPCM blocks of all files are decoded together."""
    parsed = [parse(x) for x in media]
    out: list = [None] * len(media)
    by_block: dict[int, list[int]] = {}
    for k, (tag, rate, block, data) in enumerate(parsed):
        if tag in (MULAW, ALAW):
            out[k] = data, rate, (_mulaw if tag == MULAW else _alaw)[np.frombuffer(data, np.uint8)]
        elif tag == PCM:
            out[k] = data, rate, np.frombuffer(data, "<i2")
        elif tag == ADPCM and len(data) % block == 0:
            by_block.setdefault(block, []).append(k)
        elif tag == ADPCM:
            out[k] = data, rate, adpcm_decode(data, block)
        else:
            raise ValueError(f"format {tag} is not known here")
    for block, which in by_block.items():
        made, at = adpcm_decode(b"".join([parsed[k][3] for k in which]), block), 0
        for k in which:
            data = parsed[k][3]
            n = len(data) // block * (2 * (block - 4) + 1)
            out[k] = data, parsed[k][1], made[at : at + n]
            at += n
    return out


def feature(samples: np.ndarray) -> str:
    """Peak, root mean square, zero crossings and crc32 of resampled PCM."""
    x = samples.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};peak={int(np.abs(x).max(initial=0))};rms={np.sqrt((x * x).sum() / max(len(x), 1)):.3f};zc={crossings};pcm={zlib.crc32(samples.astype('<i2').tobytes()):08x}"


def encode(docs: DataFrame, tag: int | None = None) -> DataFrame:
    """doc_id, n_bytes and the media column: one WAVE file for each text, in the format ``tag`` or the one its payload settles."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, media = [], []
            for x in batch.column(1):
                text = x.as_buffer().to_pybytes() if x.is_valid else b""
                payload = text + bytes(-len(text) % BLOCK if text else BLOCK)
                of = tag or tag_of(payload)
                sizes.append(len(text))
                media.append(wave(of, payload, block=BLOCK, bits=4) if of == ADPCM else wave(of, payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    common.arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame, rate: int = OUT_RATE) -> DataFrame:
    """Payload, features and the resampled 16-bit PCM (lifted, see ``lift``) of each row of doc_id, n_bytes and media."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            docs, sizes = (batch.column(k).to_pylist() for k in range(2))
            at = 0
            while at < batch.num_rows:  # PCM is four times a mu-law file, eight times an ADPCM file: some files at a time
                stored, held = [], 0
                while at + len(stored) < batch.num_rows and (not stored or held < common.BATCH_BYTES // 8):
                    stored.append(batch.column(2)[at + len(stored)].as_py())
                    held += len(stored[-1])
                rows = []
                for doc, n, x, (data, of, samples) in zip(docs[at:], sizes[at:], stored, pcm(stored)):
                    sounds = resample(samples, of, rate)
                    rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature(sounds), lift(sounds)))
                at += len(stored)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    common.arrow_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op9_telephony_media(spark, sf_dir: str) -> DataFrame:
    stored, _ = common.stage(encode(common.table(spark, sf_dir, "documents")), "media", **SMALL)
    sounds, _ = common.stage(decode(stored), "pcm", **SMALL)
    return sounds.drop("pcm")
