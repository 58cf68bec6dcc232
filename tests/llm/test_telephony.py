import struct

import numpy as np
import pytest

from tessera.llm import telephony as tp

SCHEMA = "doc_id long, codec string, rate int, payload binary, pcm string"


def slow_mulaw(b):
    b = ~b & 255
    v = (((b & 15) << 3) + 0x84) << ((b & 0x70) >> 4)
    return 0x84 - v if b & 0x80 else v - 0x84


def slow_alaw(b):
    b ^= 0x55
    t, seg = (b & 15) << 4, (b & 0x70) >> 4
    t += 8 if seg == 0 else 0x108
    t <<= max(0, seg - 1)
    return t if b & 0x80 else -t


def slow_adpcm(data, block=tp.BLOCK):
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block]
        if len(b) < 4:
            break
        value, index = struct.unpack("<hB", b[:3])
        index = min(index, 88)
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(tp.STEPS[index])
                diff = step >> 3
                for bit, shift in ((4, 0), (2, 1), (1, 2)):
                    if code & bit:
                        diff += step >> shift
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                out.append(value)
    return out


def encode_adpcm(samples, block=tp.BLOCK):
    """A plain encoder, for round trips."""
    out, per = b"", 2 * block - 7
    index = 0
    for at in range(0, len(samples), per):
        part = samples[at : at + per]
        value = int(part[0])
        out += struct.pack("<hBB", value, index, 0)
        codes = []
        for s in part[1:]:
            step, diff = int(tp.STEPS[index]), int(s) - value
            code, diff = (8, -diff) if diff < 0 else (0, diff)
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                if diff >= step >> shift:
                    code, diff = code | bit, diff - (step >> shift)
            value = max(-32768, min(32767, value + int(tp._DELTA[index, code])))
            index = max(0, min(88, index + int(tp._MOVE[code])))
            codes.append(code)
        codes += [0] * (len(codes) % 2)
        out += bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2]))
    return out


def test_tables():
    assert tp.MULAW.tolist() == [slow_mulaw(b) for b in range(256)]
    assert tp.ALAW.tolist() == [slow_alaw(b) for b in range(256)]
    assert len(tp.STEPS) == 89 and (np.diff(tp.STEPS) > 0).all()


def test_adpcm_blocks_against_plain_python():
    rng = np.random.default_rng(0)
    data = [rng.bytes(n) for n in (0, 3, 4, 5, 255, 256, 257, 259, 260, 1000, 2048)]
    got = tp.adpcm(data)
    assert [g.tolist() for g in got] == [slow_adpcm(d) for d in data]
    assert [len(g) for g in got] == [tp._adpcm_samples(len(d)) for d in data]


def test_adpcm_round_trip():
    t = np.arange(8000) / 8000
    wave = (12000 * np.sin(2 * np.pi * 440 * t) + 3000 * np.sin(2 * np.pi * 950 * t)).astype(np.int16)
    got = tp.adpcm([encode_adpcm(wave)])[0][: len(wave)]
    noise = (got - wave.astype(float))[500:]
    assert np.sqrt((noise**2).mean()) < 0.04 * np.sqrt((wave.astype(float) ** 2).mean())


@pytest.mark.parametrize("rate", [8000, 11025, 16000, 44100])
def test_resampled_tone(rate):
    n = rate // 2
    tone = lambda r, k: 10000 * np.sin(2 * np.pi * 700 * np.arange(k) / r)
    got = tp.resample(tone(rate, n).astype(np.int16), rate)
    assert len(got) == -(-n * 16000 // rate)
    middle = slice(300, len(got) - 300)
    assert np.abs(got[middle] - tone(16000, len(got))[middle]).max() < 150


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    long = rng.bytes(3_000_000)
    rows = [(1, "mulaw", 8000, b""), (2, "mulaw", 8000, None), (3, None, 8000, b"ab"), (4, "opus", 8000, b"ab"), (5, "alaw", 0, b"ab"), (6, "alaw", None, b"ab")]
    rows += [(7, "ima_adpcm", 8000, b"abc"), (8, "mulaw", 16000, bytes(range(256))), (None, "alaw", 8000, b"xyz"), (9, "ima_adpcm", 8000, long), (9, "ima_adpcm", 8000, long)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = tp.decode(frame)
    assert out.columns == ["doc_id", "codec", "rate", "n_samples", "n_out", "pcm"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1].pcm == b"" and got[7].pcm == b"" and got[1].n_out == 0
    assert all(got[i].pcm is None and got[i].n_samples is None for i in (2, 3, 4, 5, 6))
    assert np.frombuffer(got[8].pcm, "<i2").tolist() == tp.MULAW.tolist()
    assert got[None].n_out == 6 and got[9].n_samples == tp._adpcm_samples(len(long)) and got[9].n_out == 2 * got[9].n_samples
    assert tp.decode(frame.where("false")).count() == 0
    docs = spark.createDataFrame([(0, "é"), (4, None), (None, "x")], "doc_id long, text string")
    assert [(r.codec, r.payload) for r in tp.recordings(docs).collect()] == [("mulaw", "é".encode()), ("alaw", None), (None, b"x")]
