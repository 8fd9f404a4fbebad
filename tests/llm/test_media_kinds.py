"""MPEG versions and layers, tables of variable bitrate, seeking."""

import struct

import pytest

from quarry.llm import media

# version bits, layer bits, number of the bitrate, number of the rate, padded: length, samples, rate by the published tables
KINDS = [
    (3, 1, 9, 0, 0, 417, 1152, 44100),  # MPEG-1 Layer III, 128 kbit/s
    (3, 1, 9, 0, 1, 418, 1152, 44100),
    (3, 2, 10, 1, 0, 576, 1152, 48000),  # MPEG-1 Layer II, 192
    (3, 3, 12, 1, 0, 384, 384, 48000),  # MPEG-1 Layer I, 384
    (3, 3, 12, 1, 1, 388, 384, 48000),
    (2, 1, 8, 0, 0, 208, 576, 22050),  # MPEG-2 Layer III, 64
    (2, 2, 8, 2, 0, 576, 1152, 16000),  # MPEG-2 Layer II, 64
    (2, 3, 14, 2, 0, 768, 384, 16000),  # MPEG-2 Layer I, 256
    (0, 1, 1, 2, 0, 72, 576, 8000),  # MPEG-2.5 Layer III, 8
]


def frame(version, layer, kbps, rate, pad, length, body=b"", crc=None, mode=0):
    head = bytes((0xFF, 0xE0 | version << 3 | layer << 1 | (crc is None), kbps << 4 | rate << 2 | pad << 1, mode << 6))
    return (head + (b"" if crc is None else crc.to_bytes(2, "big")) + body).ljust(length, b"\0")


@pytest.mark.parametrize("kind", KINDS)
def test_kinds(kind):
    *bits, length, samples, rate = kind
    junk = b"\xff\xfbno frame\xff"
    audio = media.parse(junk + frame(*bits, length) * 5 + b"rest")
    assert audio.offsets == [len(junk) + k * length for k in range(5)] and audio.skipped == len(junk) + 4
    assert audio.duration == media.Fraction(5 * samples, rate) and audio.rate == rate and audio.vbr is None and audio.table_agrees is None
    for k in range(5):
        at = media.Fraction(k * samples, rate)
        assert audio.seek(at) == audio.offsets[k] == audio.seek(at + media.Fraction(samples - 1, rate))
    assert audio.seek(audio.duration) is None and audio.seek(-1) is None and media.parse(b"").seek(0) is None


def test_reserved_headers():
    for bits in ((1, 1, 9, 0, 0), (3, 0, 9, 0, 0), (3, 1, 0, 0, 0), (3, 1, 15, 0, 0), (3, 1, 9, 3, 0)):
        assert media.parse(frame(*bits, 417) * 5).offsets == []


@pytest.mark.parametrize("version,layer,mode,covered,length", [(3, 1, 0, 32, 417), (3, 1, 3, 17, 417), (2, 1, 0, 17, 261), (2, 1, 3, 9, 261), (3, 3, 0, 32, 312), (3, 3, 3, 16, 312), (3, 3, 1, 18, 312)])
def test_checksums(version, layer, mode, covered, length):
    bits, body = (version, layer, 9, 0, 0), bytes(range(1, covered + 1))
    head = frame(*bits, 4, crc=0, mode=mode)
    good = frame(*bits, length, body, media.crc16(head[2:4] + body), mode)
    assert len(good) == length
    audio = media.parse(good * 4)
    assert (len(audio.offsets), audio.damaged) == (4, 0)
    for at in (6, 5 + covered):  # the first and the last byte that it covers
        bad = bytearray(good)
        bad[at] ^= 1
        assert media.parse(good + bytes(bad) + good * 2).damaged == 1
    free = bytearray(good)
    free[6 + covered] ^= 1  # the first that it does not
    assert media.parse(good + bytes(free) + good * 2).damaged == 0


@pytest.mark.parametrize("counted", [4, 5])
def test_vbri(counted):
    bits, length = KINDS[0][:5], 417
    said = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5 * length, counted, 2, 1, 2, 2) + struct.pack(">HH", 2 * length, 2 * length)
    audio = media.parse(frame(*bits, length, bytes(32) + said) + frame(*bits, length) * 4)
    assert audio.vbr == {"frames": counted, "bytes": 5 * length, "frames_per_entry": 2, "sizes": [2 * length, 2 * length]}
    assert audio.offsets == [length * k for k in range(1, 5)] and audio.table_agrees is (counted == 4)


def test_lost_frames_are_seen():
    stream = media.encode(bytes(range(256)) * 40)
    whole = media.parse(stream)
    assert whole.table_agrees is True
    assert media.parse(stream[: whole.offsets[3]] + stream[whole.offsets[4] :]).table_agrees is False


def test_columns(spark):
    stream = media.encode(b"x" * 5000)
    rows = [("a", stream), ("b", frame(*KINDS[5][:5], 208) * 3), ("c", b"no audio"), ("d", None)]
    got = {r["id"]: r for r in media.audio_columns(spark.createDataFrame(rows, "id string, content binary")).collect()}
    assert (got["a"]["version"], got["a"]["layer"], got["a"]["table_agrees"], got["a"]["tags"]["n_bytes"]) == ("1", 3, True, "5000")
    assert (got["b"]["version"], got["b"]["layer"], got["b"]["table_agrees"], got["b"]["tags"], got["b"]["n_frames"]) == ("2", 3, None, {}, 3)
    assert all((got[k]["version"], got[k]["layer"], got[k]["n_frames"], got[k]["table_agrees"]) == (None, None, 0, None) for k in "cd")
