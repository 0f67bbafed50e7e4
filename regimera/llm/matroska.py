"""Matroska containers: a lossless writer for 8-bit samples and a parser into packet tables.

The writer stores a payload of 8-bit samples as one uncompressed PCM track: EBML header, segment, segment
information, track entry, clusters of laced SimpleBlocks (EBML, fixed-size and Xiph lacing in turn) and cues that
point at every cluster. The parser reads variable-length element ids and sizes, walks the elements (unknown sizes
end at the next element of the same or a higher level), undoes all three lacings and returns a packet for each
frame: track, timestamp in microseconds, byte range in the file, key-frame flag, cluster; cues are checked against
the clusters they point at.

Elements may nest to any depth: the walk keeps its own stack. Timestamps, durations and sizes of any length are read.

Cases: a null text is an empty one, and a null blob gives no packets; repeated rows are stored each; an empty table gives an
empty result; extra columns are ignored; an empty payload gives a container without clusters; unknown elements are skipped by their size; a cut-off
file yields the packets that are whole; bytes that are no EBML give no packets. Rows are independent, so nothing
is shuffled and memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION, FLAG_LACING = 0xB5, 0x9F, 0x6264, 0x23E383, 0x9C
TIMESTAMP_SCALE, MUXER, WRITER, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, POSITION = 0xE7, 0xA3, 0xA0, 0xA1, 0xA7
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS, EBML}
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

FRAME = 576
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32
SAMPLE_RATE = 48000
#: 576 samples at 48 kHz last 12 ms; timestamps count milliseconds.
FRAME_MS = FRAME * 1000 // SAMPLE_RATE


def _vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _uint(eid: int, n: int) -> bytes:
    return _element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], kind: int) -> bytes:
    """Lace head and frames; kind 1 Xiph, 2 fixed size, 3 EBML."""
    head = bytes([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        head += _vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            step = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(step) < (1 << (7 * w - 1)))
            head += _vint(step + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file whose only track holds payload as unsigned 8-bit samples."""
    header = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXER, b"regimera") + _element(WRITER, b"regimera"))
    audio = _element(AUDIO, _element(RATE, np.array(SAMPLE_RATE, ">f8").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1)
    entry += _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    body, points = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))], []
    at = sum(map(len, body))
    per = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for c in range(0, len(frames), per):
        parts = [_uint(TIMESTAMP, c * FRAME_MS)]
        for k, b in enumerate(range(c, min(c + per, len(frames)), FRAMES_PER_BLOCK)):
            group = frames[b : b + FRAMES_PER_BLOCK]
            kind = 0 if len(group) == 1 else (2, 3, 1)[k % 3]
            if kind == 2 and len(group[-1]) != len(group[0]):
                kind = 3
            head = b"\x81" + ((b - c) * FRAME_MS).to_bytes(2, "big") + bytes([0x80 | kind << 1])
            parts.append(_element(SIMPLE_BLOCK, head + (_laced(group, kind) if kind else group[0])))
        cluster = _element(CLUSTER, b"".join(parts))
        place = _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))
        points.append(_element(CUE_POINT, _uint(CUE_TIME, c * FRAME_MS) + place))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(points)))
    return header + _element(SEGMENT, b"".join(body))


@dataclass
class Parsed:
    """Packets in file order: (track, timestamp_us, start, end, key, cluster)."""

    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    blocks: int = 0
    lacings: list[int] = field(default_factory=lambda: [0, 0, 0, 0])

    @property
    def cues_valid(self) -> bool:
        known = set(self.clusters)
        return all(p in known for _, _, p in self.cues)


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """(value, bytes read); value -1 is the unknown size. Raises IndexError or ValueError at bad bytes."""
    first = data[at]
    if first == 0:
        raise ValueError("no length marker in the first byte")
    width = 9 - first.bit_length()
    raw = data[at : at + width]
    if len(raw) < width:
        raise IndexError("cut off")
    n = int.from_bytes(raw, "big")
    if keep_marker:
        return n, width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), width


def _block(out: Parsed, data: bytes, start: int, end: int, clock: int, scale: int, simple: bool) -> None:
    track, width = read_vint(data, start, False)
    at = start + width
    offset, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        sizes = [end - at]
    else:
        n = data[at] + 1
        at += 1
        if kind == 2:
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for i in range(n - 1):
                if kind == 1:
                    size = 0
                    while data[at] == 255:
                        size += 255
                        at += 1
                    size += data[at]
                    at += 1
                else:
                    raw, width = read_vint(data, at, False)
                    size = raw if i == 0 else sizes[-1] + raw - ((1 << (7 * width - 1)) - 1)
                    at += width
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed the block")
    out.blocks += 1
    out.lacings[kind] += 1
    step = out.tracks.get(track, {}).get("frame_ns", 0)
    base = (clock + offset) * scale
    for i, size in enumerate(sizes):
        out.packets.append((track, (base + i * step) // 1000, at, at + size, bool(flags & 0x80) if simple else True, len(out.clusters) - 1))
        at += size


def parse(data: bytes) -> Parsed:
    """All packets of a Matroska file; stops quietly where the bytes end or stop making sense."""
    out = Parsed()
    state = {"clock": 0, "scale": 1_000_000, "segment": 0}

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def leave(eid: int, here: dict, inside: dict) -> None:
        """What a closed master hands to the one it lies in."""
        if eid == TRACK_ENTRY:
            out.tracks[here.get("track", 0)] = here
        elif eid == AUDIO:
            inside.update(here)
        elif eid == CUE_TRACK_POSITIONS:
            inside.setdefault("places", []).append((here.get("cue_track", 0), here.get("cue_at", -1)))
        elif eid == CUE_POINT:
            out.cues += [(here.get("time", 0), t, p) for t, p in here.get("places", [])]

    # Open masters, innermost last: (id, end, ids that end it if its size is unknown, facts). No recursion: nesting may be any depth.
    stack: list[tuple[int, int, set, dict]] = [(0, len(data), set(), {})]

    def close() -> None:
        eid, _, _, here = stack.pop()
        leave(eid, here, stack[-1][3])

    def walk() -> None:
        at = 0
        while True:
            while len(stack) > 1 and at >= stack[-1][1]:
                close()
            if at >= stack[-1][1]:
                return
            head = at
            eid, width = read_vint(data, at, True)
            size, more = read_vint(data, at + width, False)
            at += width + more
            while len(stack) > 1 and eid in stack[-1][2]:
                close()
            _, end, _, inside = stack[-1]
            stop = end if size < 0 else at + size
            if stop > end:
                if eid not in MASTERS:
                    raise IndexError("cut off")
                stop = end
            if eid in MASTERS:
                if eid == SEGMENT:
                    state["segment"] = at
                elif eid == CLUSTER:
                    out.clusters.append(head - state["segment"])
                ends = set() if size >= 0 else TOP - {EBML, SEGMENT} if eid == CLUSTER else {EBML, SEGMENT}
                stack.append((eid, stop, ends, {}))
                continue
            if eid == TIMESTAMP:
                state["clock"] = number(at, stop)
            elif eid == TIMESTAMP_SCALE:
                state["scale"] = number(at, stop)
            elif eid in (SIMPLE_BLOCK, BLOCK):
                _block(out, data, at, stop, state["clock"], state["scale"], eid == SIMPLE_BLOCK)
            elif eid == TRACK_NUMBER:
                inside["track"] = number(at, stop)
            elif eid == DEFAULT_DURATION:
                inside["frame_ns"] = number(at, stop)
            elif eid == CODEC_ID:
                inside["codec"] = data[at:stop].decode("ascii", "replace")
            elif eid == CHANNELS:
                inside["channels"] = number(at, stop)
            elif eid == BIT_DEPTH:
                inside["bits"] = number(at, stop)
            elif eid == CUE_TIME:
                inside["time"] = number(at, stop)
            elif eid == CUE_TRACK:
                inside["cue_track"] = number(at, stop)
            elif eid == CUE_CLUSTER_POSITION:
                inside["cue_at"] = number(at, stop)
            at = stop

    try:
        walk()
    except (IndexError, ValueError):
        while len(stack) > 1:
            close()
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of the text and its bytes padded with 255 to a positive multiple of the frame."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    whole = max(FRAME, -(-len(raw) // FRAME) * FRAME)
    return len(raw), raw + b"\xff" * (whole - len(raw))


def feature(parsed: Parsed, samples: bytes) -> str:
    """Container and signal features as one string: counts of packets, blocks, lacings, duration, level, crossings."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    cross = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    last = parsed.packets[-1][1] if parsed.packets else 0
    lace = "/".join(map(str, parsed.lacings))
    return f"p{len(parsed.packets)},b{parsed.blocks},l{lace},c{len(parsed.clusters)},q{len(parsed.cues)}{'' if parsed.cues_valid else '!'},t{last},m{int(x.sum())},e{int((x * x).sum())},z{cross}"


PACKET_SCHEMA = "media_id bigint, packet int, track int, timestamp_us bigint, start bigint, end bigint, key boolean, cluster int, codec string"


def packet_table(media: DataFrame, media_id: str = "media_id", content: str = "media") -> DataFrame:
    """One row for each packet of each Matroska file in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = parse(blob.as_py() or b"")
                rows = [(key, i, *p, found.tracks.get(p[0], {}).get("codec")) for i, p in enumerate(found.packets)]
                columns = list(zip(*rows)) if rows else [[]] * 9
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
                names = ["media_id", "packet", "track", "timestamp_us", "start", "end", "key", "cluster", "codec"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    ship(media.sparkSession)
    return media.select(media[media_id].cast("bigint"), media[content]).mapInArrow(run, PACKET_SCHEMA)


DIGEST_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Stores each whole text as Matroska, reads it back through the packet ranges and returns digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, payload = padded(text.as_py())
                media = write(payload)
                found = parse(media)
                view = memoryview(media)
                back = b"".join([view[a:b] for _, _, a, b, _, _ in found.packets])
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(found, back)))
            columns = list(zip(*rows)) if rows else [[]] * 8
            i, s = pa.int64(), pa.string()
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (i, i, i, s, i, i, s, s))], names)

    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, DIGEST_SCHEMA)
