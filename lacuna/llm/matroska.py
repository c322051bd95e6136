"""Media columns: Matroska files in binary columns, as tables of packets.

``packets`` parses the variable-length EBML elements of each file (known and unknown sizes,
clusters, simple blocks and block groups, the three kinds of lacing, cues) into one row for each
packet with its track, timestamp and byte range.  ``store`` writes bytes as a file with one 8-bit
PCM track, and ``digest`` reads such files back through the same parser.

Defined cases: a null text is stored as an empty one (a single frame of padding); a null, empty or
foreign file has no packets; a file that breaks off yields the packets before the break and
``complete`` is false; equal texts give equal files; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapped, parts, table, texts

# Element ids of the format (fixed values).
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
LACED, BLOCKS = 8, 32
PAD = b"\xff"


# ---- writing -------------------------------------------------------------------------------


def vint(n: int, length: int = 0) -> bytes:
    """n as an EBML size, in as few bytes as hold it (all ones are reserved) or in ``length`` bytes."""
    while not length or n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """Frame count and sizes as the lacing says, then the frames."""
    if kind == "none":
        return frames[0]
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            d, k = n - before, 1
            while not -(1 << 7 * k - 1) < d < 1 << 7 * k - 1:
                k += 1
            head += vint(d + (1 << 7 * k - 1) - 1, k)
    return head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME, lacing: str = "fixed", laced: int = LACED) -> bytes:
    """A file with the payload (a multiple of ``frame``) as 8-bit samples of track 1."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)))
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
    entry += uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(AUDIO, audio)
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    each = 1 if lacing == "none" else laced
    flags = 0x80 | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing]
    for first in range(0, len(frames), each * BLOCKS):
        body = [uint(TIMESTAMP, first * FRAME_MS)]
        for i in range(first, min(first + each * BLOCKS, len(frames)), each):
            block = b"\x81" + struct.pack(">hB", (i - first) * FRAME_MS, flags) + lace(frames[i : i + each], lacing)
            body.append(element(SIMPLE_BLOCK, block))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# ---- reading -------------------------------------------------------------------------------


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, keyframe, lacing, cluster, offset, size); clusters: where they start."""

    packets: list[tuple] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    complete: bool = False


class _Broken(Exception):
    """The file ends, or says something impossible, inside an element."""


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next position); -1 stands for the reserved 'unknown' size."""
    if at >= len(data) or not data[at]:
        raise _Broken
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise _Broken
    n = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return n, at + length
    n &= (1 << 7 * length) - 1
    return (-1 if n == (1 << 7 * length) - 1 else n), at + length


def children(data: bytes, at: int, end: int, ends=frozenset()):
    """(id, body start, body end) of the elements from ``at``; stops before an id in ``ends`` (unknown-size parents)."""
    while at < end:
        kind, body = read_vint(data, at, keep_marker=True)
        if kind in ends:
            return
        size, body = read_vint(data, body)
        if size < 0:
            if kind == SEGMENT:
                stop = end
            elif kind == CLUSTER:
                stop = body
                for _, _, stop in children(data, body, end, _TOP):  # noqa: B007
                    pass
            else:
                raise _Broken
        else:
            stop = body + size
        yield kind, body, min(stop, end)
        if stop > end:
            raise _Broken
        at = stop


def sizes_of(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first one starts."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise _Broken
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise _Broken
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise _Broken
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            was = at
            size, at = read_vint(data, at)
            if i:
                size = sizes[-1] + size - ((1 << 7 * (at - was) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise _Broken
    return sizes, at


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _block(out: Media, data: bytes, at: int, end: int, cluster: int, time: int, simple: bool) -> None:
    track, at = read_vint(data, at)
    if at + 3 > end:
        raise _Broken
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    lacing = flags >> 1 & 3
    sizes, at = sizes_of(data, at + 3, end, lacing)
    step = out.tracks.get(track, {}).get("duration", 0)
    start = (time + relative) * out.scale
    for i, size in enumerate(sizes):
        out.packets.append((track, start + i * step, bool(flags & 0x80) if simple else None, LACINGS[lacing], cluster, at, size))
        at += size


def parse(data: bytes | None) -> Media:
    """All packets, tracks and cues of a file, as far as it is sound."""
    out = Media()
    data = data or b""
    try:
        top = list(children(data, 0, len(data))) if data[:4] == b"\x1a\x45\xdf\xa3" else []
        for kind, at, end in top:
            if kind == SEGMENT:
                _segment(out, data, at, end)
        out.complete = bool(top)
    except _Broken:
        # what lies before the break: walk again, keeping what comes
        out = Media()
        try:
            for kind, at, end in children(data, 0, len(data)):
                if kind == SEGMENT:
                    _segment(out, data, at, end)
        except _Broken:
            pass
    return out


def _segment(out: Media, data: bytes, base: int, end: int) -> None:
    begin = base
    for kind, at, stop in children(data, base, end):
        begin, start = stop, begin
        if kind == INFO:
            for k, a, b in children(data, at, stop):
                out.scale = _number(data, a, b) if k == TIMESTAMP_SCALE else out.scale
        elif kind == TRACKS:
            for k, a, b in children(data, at, stop):
                if k == TRACK_ENTRY:
                    own = {x: (p, q) for x, p, q in children(data, a, b)}
                    text = lambda x, own=own: data[slice(*own[x])] if x in own else b""
                    out.tracks[int.from_bytes(text(TRACK_NUMBER), "big")] = {
                        "codec": text(CODEC_ID).decode("ascii", "replace"),
                        "kind": int.from_bytes(text(TRACK_TYPE), "big"),
                        "duration": int.from_bytes(text(DEFAULT_DURATION), "big"),
                    }
        elif kind == CLUSTER:
            out.clusters.append(start)
            time = 0
            for k, a, b in children(data, at, stop, _TOP):
                if k == TIMESTAMP:
                    time = _number(data, a, b)
                elif k == SIMPLE_BLOCK:
                    _block(out, data, a, b, len(out.clusters) - 1, time, True)
                elif k == BLOCK_GROUP:
                    for x, p, q in children(data, a, b):
                        if x == BLOCK:
                            _block(out, data, p, q, len(out.clusters) - 1, time, False)
        elif kind == CUES:
            for k, a, b in children(data, at, stop):
                if k == CUE_POINT:
                    time = 0
                    for x, p, q in children(data, a, b):
                        if x == CUE_TIME:
                            time = _number(data, p, q)
                        elif x == CUE_POSITIONS:
                            own = {y: _number(data, c, d) for y, c, d in children(data, p, q)}
                            out.cues.append((time, own.get(CUE_TRACK, 0), base + own.get(CUE_CLUSTER, 0)))


# ---- on tables -----------------------------------------------------------------------------

_PACKET = "track long, timestamp_ns long, keyframe boolean, lacing string, cluster int, offset long, size long"


def packets(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each packet: key, packet (its place in the file), track, timestamp, byte range, sound file or not."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = parse(data)
                rows += [(k, i, *p, got.complete) for i, p in enumerate(got.packets)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema.fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], names=arrow.names
            )

    from pyspark.sql.pandas.types import to_arrow_schema

    chosen = media.select(F.col(key).alias("key"), F.col(column).cast("binary").alias("data"))
    kind = chosen.schema["key"].dataType.simpleString()
    schema = media.sparkSession.createDataFrame([], f"key {kind}, packet long, {_PACKET}, complete boolean").schema
    arrow = to_arrow_schema(schema)
    return mapped(chosen, run, schema)


def payload_of(text: bytes) -> bytes:
    """A text padded with bytes 255 to a positive multiple of the frame size."""
    return text + PAD * (-len(text) % FRAME if text else FRAME)


def lacing_of(text: bytes) -> str:
    """Files differ in their lacing, by a rule of the text's length."""
    return LACINGS[len(text) // FRAME % len(LACINGS)]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a Matroska file."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            made = texts(batch)
            files = [write(payload_of(x), lacing=lacing_of(x)) for x in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in made], pa.int64()), pa.array(files, pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(chosen, run, "doc_id long, n_bytes long, media binary")


def sound_cues(media: Media) -> int:
    """Cues that lead to a cluster in which a packet of their track has their time."""
    places = {(p[4], p[0], p[1] // 1_000_000) for p in media.packets}
    at = {start: k for k, start in enumerate(media.clusters)}
    return sum((at.get(start), track, time) in places for time, track, start in media.cues)


def feature(media: Media, payload: bytes) -> str:
    """Plain facts of the packets and of the samples that they carry, all whole numbers."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    last = max((p[1] for p in media.packets), default=0) // 1_000_000
    lacings = ",".join(sorted({p[3] for p in media.packets}))
    return (
        f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};sound_cues={sound_cues(media)};tracks={len(media.tracks)};lacing={lacings}"
        f";last_ms={last};sum={int(samples.sum())};energy={int((samples * samples).sum())};crossings={crossings}"
    )


def digest(stored: DataFrame) -> DataFrame:
    """Digests of what each stored file holds, read back through the parser."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, "media")):
            rows = []
            for media in batch.column("media").to_pylist():
                got = parse(media)
                back = b"".join(media[p[5] : p[5] + p[6]] for p in got.packets)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(got, back)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [x.split()[0] for x in out.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], names=names)

    return mapped(stored, run, out)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents")))
