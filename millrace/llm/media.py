"""Media columns: ISO media containers, written and walked without decoding payloads.

write_container() stores a byte payload losslessly as 8 x 8 frames of 8-bit grey samples (64 bytes a frame) in an ISO container: ftyp,
moov with one video track and its sample tables, mdat. tracks() walks the nested boxes of any such container, decodes each track's own sample
tables (stts, stsz or stz2, stsc, stco or co64, stss) and the runs of its fragments (moof, tfhd, trun), and gives codec, duration and the samples' byte
ranges; it never decodes a sample. The features of a row are its first video track's, key-frame byte ranges included.

Cases: a null payload is stored as an empty one, padded to 64 zero bytes; equal payloads give equal containers; a truncated or foreign
file gives null features instead of an error; repeated rows and extra columns pass unharmed; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import map_batches, staged, utf8, with_id

FRAME = 64
#: Frames a second, frames in a chunk, and frames from one key frame to the next.
RATE, CHUNK, GROUP = 25, 512, 32
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """payload with zero bytes up to a positive multiple of a frame."""
    return payload + bytes(max(FRAME, -(-len(payload) // FRAME) * FRAME) - len(payload))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body if len(body) + 8 < 1 << 32 else struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """An ISO media file that holds payload, a positive multiple of 64 bytes, as grey frames."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"Y800", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8), struct.pack(">IIIH", 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else [(1, n, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, n % CHUNK, 1)]
    keys = np.arange(1, n + 1, GROUP, dtype=">u4")

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
        wide = len(payload) + (1 << 20) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    base = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(base) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: bytes = b""):
    """(path, first byte, end) of every box, parents first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("box beyond its parent")
        here = path + b"/" + kind
        yield here, start + head, start + size
        if kind in _CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size


def _runs(table: np.ndarray, n: int) -> np.ndarray:
    """Samples in each of n chunks, from the sample-to-chunk table."""
    per = np.zeros(n, np.int64)
    for k, (first, count, _) in enumerate(table):
        per[first - 1 : table[k + 1][0] - 1 if k + 1 < len(table) else n] = count
    return per


class _Box:
    """Big-endian numbers of a box's body."""

    def __init__(self, data: memoryview, start: int, end: int):
        self.data, self.at, self.end = data, start, end

    def take(self, kind: str, count: int = 1) -> np.ndarray:
        size = np.dtype(kind).itemsize * count
        if count < 0 or self.at + size > self.end:
            raise ValueError("table beyond its box")
        self.at += size
        return np.frombuffer(self.data, kind, count, self.at - size).astype(np.int64)

    def one(self, kind: str = ">u4") -> int:
        return int(self.take(kind)[0])

    def full(self) -> tuple[int, int]:
        """Version and flags."""
        return divmod(self.one(), 1 << 24)

    def text(self, n: int) -> str:
        self.at += n
        return bytes(self.data[self.at - n : self.at]).decode("latin-1")


def _sizes(boxes: dict[str, _Box]) -> np.ndarray:
    """Sample sizes from stsz, or from the compact stz2 with 4, 8 or 16 bits a size."""
    if "stsz" in boxes:
        x = boxes["stsz"]
        x.full()
        each, n = x.one(), x.one()
        return np.full(n, each, np.int64) if each else x.take(">u4", n)
    x = boxes["stz2"]
    x.full()
    bits, n = x.one() & 255, x.one()
    if bits == 4:
        pairs = x.take("u1", (n + 1) // 2)
        return np.column_stack([pairs >> 4, pairs & 15]).ravel()[:n]
    return x.take({8: "u1", 16: ">u2"}[bits], n)


def _track(boxes: dict[str, _Box]) -> dict:
    """One track's description and samples, from its own boxes only."""
    x = boxes["mdhd"]
    wide = x.full()[0] == 1
    x.take(">u8" if wide else ">u4", 2)
    scale, duration = x.one(), x.one(">u8" if wide else ">u4")
    x = boxes["tkhd"]
    wide = x.full()[0] == 1
    x.take(">u8" if wide else ">u4", 2)
    number = x.one()
    x = boxes["hdlr"]
    x.take(">u4", 2)
    handler = x.text(4)
    x = boxes["stsd"]
    x.take(">u4", 3)
    codec = x.text(4).strip()
    sizes = _sizes(boxes)
    wide = "co64" in boxes
    x = boxes["co64" if wide else "stco"]
    x.full()
    chunks = x.take(">u8" if wide else ">u4", x.one())
    x = boxes["stsc"]
    x.full()
    per = _runs(x.take(">u4", 3 * x.one()).reshape(-1, 3), len(chunks))
    n = len(sizes)
    before, first = np.cumsum(sizes) - sizes, np.cumsum(per) - per
    offsets = before + np.repeat(chunks - before[np.minimum(first, n - 1)], per)[:n] if n else before
    if len(offsets) != n:
        raise ValueError("chunks do not hold all samples")
    x = boxes["stts"]
    x.full()
    times = x.take(">u4", 2 * x.one()).reshape(-1, 2)
    delta = np.repeat(times[:, 1], times[:, 0])[:n]
    if "stss" in boxes:
        x = boxes["stss"]
        x.full()
        keys = x.take(">u4", x.one()) - 1
    else:
        keys = np.arange(n)
    return {"id": number, "kind": handler, "codec": codec, "timescale": scale, "duration": duration, "sizes": sizes, "offsets": offsets, "deltas": delta, "keys": keys}


def _fragment(x: _Box, base: int, after: int, defaults: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, offsets, durations and key marks of a run of a fragment; `after`: where the run before it ended."""
    _, flags = x.full()
    n = x.one()
    start = base + x.one(">i4") if flags & 1 else after
    first = x.one() if flags & 4 else None
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    table = dict(zip(fields, x.take(">u4", n * len(fields)).reshape(n, -1).T)) if fields else {}
    of = lambda name: table.get(name, np.full(n, defaults.get(name, 0), np.int64))
    marks = of("flags").copy()
    if first is not None and n:
        marks[0] = first
    sizes = of("size")
    return sizes, start + np.cumsum(sizes) - sizes, of("duration"), marks & 0x10000 == 0


def tracks(file: bytes) -> list[dict] | None:
    """id, kind, codec, timescale, duration, sizes, offsets and durations of all samples, and the key samples of every track, fragments
    included; None for no such container, or one whose samples lie outside the file."""
    data, own, found, defaults = memoryview(file), {}, {}, {}
    try:
        traks: list[dict[str, _Box]] = []
        fragments = []
        for path, a, b in walk(data):
            name = path.rpartition(b"/")[2].decode("latin-1")
            if path == b"/moov/trak":
                traks.append({})
            elif path.startswith(b"/moov/trak/"):
                traks[-1].setdefault(name, _Box(data, a, b))
            elif path == b"/moov/mvex/trex":
                x = _Box(data, a, b)
                x.full()
                number = x.one()
                defaults[number] = dict(zip(("entry", "duration", "size", "flags"), x.take(">u4", 4).tolist()))
            elif path == b"/moof":
                moof = a - 8 if b - a + 8 < 1 << 32 else a - 16
            elif path == b"/moof/traf":
                fragments.append((moof, []))
            elif path.startswith(b"/moof/traf/") and name in ("tfhd", "trun"):
                fragments[-1][1].append((name, _Box(data, a, b)))
        own = [_track(t) for t in traks]
        found = {t["id"]: t for t in own}
        for moof, parts in fragments:
            track, known, base, after = None, {}, moof, moof
            for name, x in parts:
                if name == "tfhd":
                    _, flags = x.full()
                    track = found[x.one()]
                    known = dict(defaults.get(track["id"], {}))
                    base = x.one(">u8") if flags & 1 else moof
                    after = base
                    for bit, field in ((2, "entry"), (8, "duration"), (16, "size"), (32, "flags")):
                        if flags & bit:
                            known[field] = x.one()
                else:
                    sizes, offsets, durations, keys = _fragment(x, base, after, known)
                    after = int(offsets[-1] + sizes[-1]) if len(sizes) else after
                    track["keys"] = np.r_[track["keys"], len(track["sizes"]) + np.flatnonzero(keys)]
                    track["sizes"], track["offsets"], track["deltas"] = np.r_[track["sizes"], sizes], np.r_[track["offsets"], offsets], np.r_[track["deltas"], durations]
                    track["duration"] += int(durations.sum())
        for t in own:
            n = len(t["sizes"])
            if n and (int((t["offsets"] + t["sizes"]).max()) > len(file) or int(t["offsets"].min()) < 0) or len(t["keys"]) and not 0 <= int(t["keys"].min()) <= int(t["keys"].max()) < n:
                return None
        return own
    except (KeyError, ValueError, IndexError, UnboundLocalError, struct.error):
        return None


def media_info(file: bytes) -> dict | None:
    """The first video track, or else the first track; None for no such container."""
    own = tracks(file)
    return next((t for t in own if t["kind"] == "vide"), own[0]) if own else None


def read_payload(file: bytes, info: dict) -> bytes:
    """The samples' bytes in order, joined by the byte ranges of the sample tables."""
    ends = info["offsets"] + info["sizes"]
    breaks = np.flatnonzero(info["offsets"][1:] != ends[:-1]) + 1
    starts = np.r_[0, breaks]
    lasts = np.r_[breaks, len(ends)] - 1
    return b"".join(file[a:b] for a, b in zip(info["offsets"][starts], ends[lasts])) if len(ends) else b""


def _store(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = utf8(batch.column(1))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_container(padded(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])


def media_table(df: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """Containers, one for each row: id, n_bytes (of the payload before padding), media (binary)."""
    slim = df.select(df[id_col].alias("id"), df[payload_col].alias("payload"))
    return map_batches(slim, _store, with_id(slim, "n_bytes bigint, media binary"))


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for file in batch.column(2).to_pylist():
        info = media_info(file or b"")
        if info is None:
            rows.append((None,) * 3 + (len(file or b""), hashlib.sha256(file or b"").hexdigest()) + (None,) * 4)
            continue
        payload = read_payload(file, info)
        keys = info["keys"]
        starts, sizes = info["offsets"][keys], info["sizes"][keys]
        digest = zlib.crc32(np.stack([starts, sizes]).astype("<i8").tobytes())
        feature = f"{info['codec']};{info['duration']}/{info['timescale']}s;{len(info['sizes'])} samples;{len(keys)} keys from {starts[0] if len(keys) else 0};{digest:08x}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(file), hashlib.sha256(file).hexdigest(), feature, info["codec"], info["duration"] / max(1, info["timescale"]), list(zip(starts.tolist(), sizes.tolist()))))
    cols = list(zip(*rows))
    ranges = pa.array([None if r is None else [{"start": a, "length": b} for a, b in r] for r in cols[8]], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.float64()), ranges], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"])


def media_features(media: DataFrame) -> DataFrame:
    """Features of stored containers (id, n_bytes, media): read from the sample tables, key-frame byte ranges included."""
    return map_batches(media, _describe, with_id(media, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<start: bigint, length: bigint>>"))


def stored_media(df: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """Containers written to the shared folder, read back and described."""
    return media_features(staged(media_table(df, id_col, payload_col), "media")).withColumnRenamed("id", id_col)
