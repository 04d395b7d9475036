import hashlib
import struct
import zlib

import pytest

from millrace.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 31, 64 * 32, 64 * 512, 64 * 513, 64 * 1024 + 5, 200_000])
def test_round_trip(n):
    payload = media.padded(bytes(k * 7 & 255 for k in range(n)))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
    file = media.write_container(payload)
    info = media.media_info(file)
    assert media.read_payload(file, info) == payload
    assert info["codec"] == "Y800" and info["duration"] == len(payload) // 64 == len(info["sizes"])
    for k in info["keys"][:50]:
        a = info["offsets"][k]
        assert file[a : a + 64] == payload[k * 64 : k * 64 + 64]


def test_foreign_and_broken_files():
    file = media.write_container(bytes(640))
    for bad in (b"", b"no media", file[:-1], file[:200], file.replace(b"stsz", b"xxxx"), file.replace(b"stco", b"free")):
        assert media.media_info(bad) is None


def test_other_tables():
    """Samples of several sizes, 64-bit offsets, no list of key samples: all are."""

    file = media.write_container(bytes(range(64)) * 2)
    at = file.index(b"stsz") - 4
    sized = media.full(b"stsz", struct.pack(">II", 0, 2), struct.pack(">II", 100, 28))
    patched = file[:at] + sized + file[at + 20 :]
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        k = patched.index(kind) - 4
        patched = patched[:k] + struct.pack(">I", struct.unpack_from(">I", patched, k)[0] + 8) + patched[k + 4 :]
    k = patched.index(b"stco") + 12
    patched = patched[:k] + struct.pack(">I", struct.unpack_from(">I", patched, k)[0] + 8) + patched[k + 4 :]
    info = media.media_info(patched.replace(b"stss", b"free"))
    assert info["sizes"].tolist() == [100, 28] and info["keys"].tolist() == [0, 1]
    assert media.read_payload(patched, info) == bytes(range(64)) * 2


def test_table(docs, corpus, empty):
    got = media.stored_media(docs).collect()
    assert len(got) == len(corpus)
    by = {r["doc_id"]: r for r in got}
    for k, t, *_ in corpus:
        if k is not None:
            payload = media.padded((t or "").encode())
            r = by[k]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert r["media_bytes"] > r["payload_bytes"] and len(r["keyframes"]) == -(-len(payload) // 64 // 32)
    assert by[3]["feature"] == by[40]["feature"] and by[3]["media_sha256"] == by[40]["media_sha256"]
    assert media.stored_media(empty).count() == 0


def _trak(number, kind, codec, sizes, offsets, keys=None, wide=False, compact=None):
    """A track with one sample a chunk."""
    pack, n = struct.pack, len(sizes)
    time = lambda *after: pack(">QQ" if wide else ">II", 1, 2) + b"".join(after)
    mdhd = media.full(b"mdhd", time(pack(">I", 90), pack(">Q" if wide else ">I", 90 * n), pack(">HH", 0, 0)), version=int(wide))
    tkhd = media.full(b"tkhd", time(pack(">II", number, 0)), version=int(wide))
    stbl = [media.full(b"stsd", pack(">I", 1), media.box(codec, bytes(8))), media.full(b"stts", pack(">III", 1, n, 90)), media.full(b"stsc", pack(">IIII", 1, 1, 1, 1)), media.full(b"stco", pack(f">{n + 1}I", n, *offsets))]
    if keys is not None:
        stbl.append(media.full(b"stss", pack(f">{len(keys) + 1}I", len(keys), *(k + 1 for k in keys))))
    if compact == 4:
        padded = [*sizes, 0][: n + n % 2]
        stbl.append(media.full(b"stz2", pack(">II", 4, n), bytes(a << 4 | b for a, b in zip(padded[::2], padded[1::2]))))
    elif compact:
        stbl.append(media.full(b"stz2", pack(">II", compact, n), pack(f">{n}{'B' if compact == 8 else 'H'}", *sizes)))
    else:
        stbl.append(media.full(b"stsz", pack(f">{n + 2}I", 0, n, *sizes)))
    minf = media.box(b"minf", media.box(b"stbl", *stbl))
    return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, media.full(b"hdlr", bytes(4), kind, bytes(13)), minf))


@pytest.mark.parametrize("wide,compact", [(False, None), (True, 4), (True, 8), (False, 16)])
def test_tracks_are_read_apart(wide, compact):
    """Audio first without a list of key samples, video second with one: neither gets the other's; 64-bit times; compact sizes."""
    body = bytes(range(100))
    mdat = media.box(b"mdat", body)
    file = mdat + media.box(b"moov", _trak(1, b"soun", b"mp4a", [3, 5, 2], [8, 11, 16], wide=wide, compact=compact), _trak(2, b"vide", b"avc1", [10, 7, 9, 4], [20, 30, 40, 50], keys=[0, 2], wide=wide, compact=compact))
    sound, film = media.tracks(file)
    assert sound["keys"].tolist() == [0, 1, 2] and film["keys"].tolist() == [0, 2]
    assert (sound["codec"], sound["duration"], sound["timescale"]) == ("mp4a", 270, 90) and (film["codec"], film["duration"]) == ("avc1", 360)
    assert film["sizes"].tolist() == [10, 7, 9, 4] and film["deltas"].tolist() == [90] * 4
    assert media.media_info(file)["id"] == 2 and media.read_payload(file, sound) == body[:10]


def test_fragments():
    """Samples of fragments follow the track's own; a run's place is relative to its moof, the next run goes on behind it."""
    pack = struct.pack
    head = media.box(b"moov", _trak(1, b"vide", b"avc1", [], []), media.box(b"mvex", media.full(b"trex", pack(">IIIII", 1, 1, 40, 6, 0x10000))))

    def moof(offset):
        one = media.full(b"trun", pack(">Ii", 2, offset), pack(">I", 0), pack(">II", 5, 7), flags=0x205)
        two = media.full(b"trun", pack(">I", 1))
        return media.box(b"moof", media.full(b"mfhd", pack(">I", 1)), media.box(b"traf", media.full(b"tfhd", pack(">I", 1), flags=0x20000), one, two))

    body = bytes(range(30))
    file = head + moof(len(moof(0)) + 8) + media.box(b"mdat", body)
    (track,) = media.tracks(file)
    assert track["sizes"].tolist() == [5, 7, 6] and track["keys"].tolist() == [0] and track["deltas"].tolist() == [40] * 3
    assert track["duration"] == 120 and media.read_payload(file, track) == body[:18]
    assert media.tracks(file[:-15]) is None


def test_payloads_of_clashing_and_odd_columns(spark):
    df = spark.createDataFrame([("x", "t", 1), ("x", "t", 1), (None, None, None)], "id string, `my col` string, media int")
    got = media.stored_media(df, "id", "my col").collect()
    assert sorted((r["id"] or "", r["n_bytes"]) for r in got) == [("", 0), ("x", 1), ("x", 1)]
