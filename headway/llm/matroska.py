"""Matroska: EBML elements, clusters, lacing and cues as a packet table.

``parse`` walks the variable-length elements of one file without recursion and returns its tracks, packets (time,
track, byte range, key frame, lacing) and cues; ``packet_table`` gives one row per packet of every media row.
``mux`` writes payload bytes as 8-bit PCM in laced blocks.

Segments and clusters of unknown size end where an element of a higher level begins or the data ends. Broken or cut
data give the packets before the break and an ``error``; null and empty media have no packets and no error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import beside

#: Element ids of the format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = (
    0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469,
)
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, FLAG_LACING = (
    0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C,
)
AUDIO, SAMPLE_RATE, CHANNELS, BIT_DEPTH, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = (0xE1, 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB)
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = (0xBB, 0xB3, 0xB7, 0xF7, 0xF1)
DOC_TYPE = 0x4282
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
_OPEN = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, EBML}
LACING = ("none", "xiph", "fixed", "ebml")
#: Bytes of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, RATE = 576, 8, 32, 8000


def vint(data, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """The variable-length integer at ``at`` and the place after it; -1 stands for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("bad variable-length integer")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << (7 * width)) - 1
    return (-1 if value == (1 << (7 * width)) - 1 else value), at + width


def size_bytes(n: int) -> bytes:
    """``n`` as the shortest size of an element."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced_block(track: int, time: int, frames: list[bytes], lacing: int) -> bytes:
    """The body of a key-frame block; ``lacing`` counts as in LACING."""
    body = size_bytes(track) + struct.pack(">hB", time, 0x80 | lacing << 1)
    if lacing:
        body += bytes([len(frames) - 1])
    if lacing == 1:
        body += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    if lacing == 3:
        sizes = [len(f) for f in frames]
        for i, n in enumerate(sizes[:-1]):
            if not i:
                body += size_bytes(n)
                continue
            step, width = n - sizes[i - 1], 1
            while abs(step) > (1 << (7 * width - 1)) - 1:
                width += 1
            body += ((1 << (7 * width)) | (step + (1 << (7 * width - 1)) - 1)).to_bytes(width, "big")
    return body + b"".join(frames)


_HEADER = element(
    EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2)
)
_TRACK = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(FLAG_LACING, 1)
        + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE)
        + element(AUDIO, element(SAMPLE_RATE, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one track of 8-bit PCM whose frames are the payload in pieces of FRAME bytes."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // RATE
    info = element(INFO, _uint(TIMESTAMP_SCALE, 10**6) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(0x4D80, b"headway") + element(0x5741, b"headway"))
    head = info + _TRACK
    clusters, cues, at = [], [], len(head)
    for c in range(0, len(frames), LACED * BLOCKS):
        body = [_uint(CLUSTER_TIME, c * ms)]
        for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED):
            run = frames[b : b + LACED]
            lacing = 0 if len(run) == 1 else 2 if len({*map(len, run)}) == 1 else 3
            body.append(element(SIMPLE_BLOCK, laced_block(1, (b - c) * ms, run, lacing)))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return _HEADER + element(SEGMENT, head + b"".join(clusters) + element(CUES, b"".join(cues)))


def _frames(data, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of the frames of a block."""
    track, at = vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    if lacing == 2:
        size, odd = divmod(end - at, n)
        if odd:
            raise ValueError("uneven fixed lacing")
        return track, time, flags, [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        elif not i:
            size, at = vint(data, at)
        else:
            was = at
            raw, at = vint(data, at)
            full = 7 * (at - was)
            size = sizes[-1] + ((1 << full) - 1 if raw < 0 else raw) - ((1 << (full - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes beyond the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, flags, out


def parse(data: bytes) -> dict:
    """``tracks`` (number: fields), ``packets`` (track, time in ns, offset, size, key, lacing, cluster offset), ``cues``
    (time in ns, track, cluster offset from the segment's data), ``duration_ns``, ``clusters`` and ``error``."""
    out = {"tracks": {}, "packets": [], "cues": [], "clusters": 0, "duration_ns": 0, "error": None}
    scale, duration, base, cluster_time, cluster_at = 10**6, 0.0, 0, 0, 0
    track: dict = {}
    cue: dict = {}
    stack: list[tuple[int, int, bool]] = []  # element, end, whether the size was unknown
    packets, at, n = out["packets"], 0, len(data)
    group, depends = 0, False  # the first packet of the open block group, and whether it refers to another frame

    def close(kind: int) -> None:
        if kind == TRACK_ENTRY and "number" in track:
            out["tracks"][track["number"]] = dict(track)
        if kind == CUE_POSITIONS and {"time", "track", "cluster"} <= cue.keys():
            out["cues"].append((cue["time"] * scale, cue["track"], cue["cluster"]))

    try:
        while True:
            while stack and at >= stack[-1][1]:
                close(stack.pop()[0])
            if at >= n:
                break
            began = at
            kind, at = vint(data, at, True)
            size, at = vint(data, at)
            while stack and stack[-1][2] and kind in _TOP and (kind == SEGMENT or kind == EBML or stack[-1][0] == CLUSTER):
                close(stack.pop()[0])
            limit = stack[-1][1] if stack else n
            unknown = size < 0
            end = limit if unknown else at + size
            if unknown and kind not in (SEGMENT, CLUSTER):
                raise ValueError("unknown size of an element that must have one")
            if end > limit:
                if kind not in _OPEN:
                    raise ValueError("an element ends beyond its parent")
                out["error"] = "cut"
                end = limit
            if kind in _OPEN:
                stack.append((kind, end, unknown))
                if kind == SEGMENT:
                    base = at
                elif kind == CLUSTER:
                    out["clusters"] += 1
                    cluster_at = began - base
                elif kind == BLOCK_GROUP:
                    group, depends = len(packets), False
                elif kind == TRACK_ENTRY:
                    track = {"codec": "", "type": 0, "rate": 0.0, "channels": 1, "bits": 0, "default_ns": 0}
                elif kind == CUE_POINT:
                    cue = {}
                continue
            if kind in (SIMPLE_BLOCK, BLOCK):
                number, time, flags, ranges = _frames(data, at, end)
                step = out["tracks"].get(number, {}).get("default_ns", 0)
                start = (cluster_time + time) * scale
                key = bool(flags & 0x80) if kind == SIMPLE_BLOCK else not depends
                name = LACING[flags >> 1 & 3]
                packets.extend((number, start + i * step, o, size, key, name, cluster_at) for i, (o, size) in enumerate(ranges))
            elif size <= 8 or kind == CODEC_ID:
                body = data[at:end]
                value = int.from_bytes(body, "big")
                real = struct.unpack(">d", body)[0] if size == 8 else struct.unpack(">f", body)[0] if size == 4 else 0.0
                if kind == TIMESTAMP_SCALE:
                    scale = value
                elif kind == DURATION:
                    duration = real
                elif kind == CLUSTER_TIME:
                    cluster_time = value
                elif kind == TRACK_NUMBER:
                    track["number"] = value
                elif kind == TRACK_TYPE:
                    track["type"] = value
                elif kind == CODEC_ID:
                    track["codec"] = bytes(body).decode("utf-8", "replace")
                elif kind == DEFAULT_DURATION:
                    track["default_ns"] = value
                elif kind == SAMPLE_RATE:
                    track["rate"] = real
                elif kind == CHANNELS:
                    track["channels"] = value
                elif kind == BIT_DEPTH:
                    track["bits"] = value
                elif kind == REFERENCE and stack and stack[-1][0] == BLOCK_GROUP:  # before or after the group's block
                    depends = True
                    packets[group:] = [(*p[:4], False, *p[5:]) for p in packets[group:]]
                elif kind == CUE_TIME:
                    cue["time"] = value
                elif kind == CUE_TRACK:
                    cue["track"] = value
                elif kind == CUE_CLUSTER:
                    cue["cluster"] = value
            at = end
        while stack:
            close(stack.pop()[0])
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e) or "cut"
    out["duration_ns"] = round(duration * scale)
    return out


PACKETS = "packet long, track long, time_ns long, offset long, size long, key boolean, lacing string, cluster_offset long, error string"


def packet_table(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """One row per packet: the columns ``keep`` and PACKETS; a broken file adds a row with only its error."""

    def run(batches):
        for batch in batches:
            index, rows = [], []
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                data = x.as_py()
                if not data:
                    continue
                got = parse(data)
                index += [i] * (len(got["packets"]) + bool(got["error"]))
                rows += [(k, *p, None) for k, p in enumerate(got["packets"])]
                rows += [(None,) * 8 + (got["error"],)] * bool(got["error"])
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int64(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            left = batch.select(range(batch.num_columns - 1)).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, *columns], [*left.schema.names, *[c.split()[0] for c in PACKETS.split(", ")]])

    rows, schema = beside(media, keep, media_col, PACKETS)
    return rows.mapInArrow(run, schema)


def padded(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes of a text, and those bytes filled with 255 to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(batches):
    for batch in batches:
        rows = []
        for x in batch.column(batch.num_columns - 1):
            n, payload = padded(x.as_py())
            media = mux(payload)
            got = parse(media)
            back = b"".join([media[o : o + s] for _, _, o, s, *_ in got["packets"]])
            lacing = ",".join(sorted({p[5] for p in got["packets"]}))
            feature = (
                f"codec={got['tracks'][1]['codec']};packets={len(got['packets'])};clusters={got['clusters']};cues={len(got['cues'])};"
                f"lacing={lacing};duration_ns={got['duration_ns']};last_ns={got['packets'][-1][1]};mean={sum(back) / len(back):.6f}"
            )
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *columns],
            [*batch.schema.names[:-1], *[c.split()[0] for c in STORED.split(", ")]],
        )


def stored_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Each whole text stored as Matroska and read back from the byte ranges of its packets, with digests and features."""
    rows, schema = beside(docs, keep, text_col, STORED)
    return rows.mapInArrow(_stored, schema)
