"""Media columns: Matroska files as packet tables.

A binary column of Matroska files becomes a table of packets (track, timestamp in
ns, cluster, byte range, key flag): elements with variable-length ids and sizes
are walked, clusters and their blocks opened, all four kinds of lacing undone, cue
points read. ``mux`` writes a payload as 8-bit samples of one PCM track, so bytes
survive a round trip.

Every file is parsed in one task (a file is one value of one row) in batches of
bounded rows; nothing is shuffled.

Defined results: a null file or text counts as empty; an empty or broken file
gives the packets before the break and ``complete`` false; repeated rows give
repeated rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_of

ship(__name__)

# Element ids of the format.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NESTED = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

FRAME, SAMPLES_PER_MS = 576, 48  # a frame lasts 12 ms
LACE, BLOCKS_PER_CLUSTER = 8, 64
BATCH_ROWS = 500


class Packet(NamedTuple):
    track: int
    timestamp: int
    cluster: int
    start: int
    length: int
    key: bool


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next place) of a variable-length number; -1 is the unknown size."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("broken number")
    value = int.from_bytes(data[at : at + n], "big")
    if not keep_marker:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            value = -1
    return value, at + n


def lace_lengths(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(frame lengths, place of the first frame) of a block from its lacing head.
    lacing: 0 none, 1 Xiph, 2 fixed sizes, 3 EBML differences."""
    if lacing == 0:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("frames of unequal size")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    while len(sizes) < n - 1:
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            raw, after = vint(data, at)
            # differences are stored with an offset that makes them positive
            size = raw if not sizes else sizes[-1] + raw - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames longer than their block")
    return sizes, at


class Parsed(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, str]
    cues: list[tuple[int, int, int]]
    complete: bool


def parse(data: bytes) -> Parsed:
    """Walks the elements of a file, without recursion."""
    packets: list[Packet] = []
    tracks: dict[int, str] = {}
    cues: list[tuple[int, int, int]] = []
    scale, cluster, base, at = 1_000_000, -1, 0, 0
    state: dict[int, int] = {}
    lasting: dict[int, int] = {}

    def block(a: int, b: int, simple: bool) -> None:
        track, p = vint(data, a)
        offset, flags = struct.unpack_from(">hB", data, p)
        sizes, p = lace_lengths(data, p + 3, b, flags >> 1 & 3)
        step = lasting.get(track, 0)
        for k, size in enumerate(sizes):
            packets.append(Packet(track, (base + offset) * scale + k * step, cluster, p, size, bool(flags & 128) if simple else True))
            p += size

    try:
        while at < len(data):
            kind, p = vint(data, at, keep_marker=True)
            size, p = vint(data, p)
            end = len(data) if size < 0 else p + size
            if end > len(data):
                raise ValueError("element longer than the file")
            if kind in NESTED:
                cluster = cluster + 1 if kind == CLUSTER else cluster
                at = p
                continue
            if kind in (SIMPLE, BLOCK):
                block(p, end, kind == SIMPLE)
            elif kind == REFERENCE and packets:
                packets[-1] = packets[-1]._replace(key=False)
            elif kind == SCALE:
                scale = int.from_bytes(data[p:end], "big")
            elif kind == TIME:
                base = int.from_bytes(data[p:end], "big")
            elif kind in (NUMBER, CUE_TIME, CUE_TRACK):
                state[kind] = int.from_bytes(data[p:end], "big")
            elif kind == CODEC:
                tracks[state.get(NUMBER, 0)] = data[p:end].decode("ascii", "replace")
            elif kind == 0x23E383:  # default duration of a frame, ns
                lasting[state.get(NUMBER, 0)] = int.from_bytes(data[p:end], "big")
            elif kind == CUE_CLUSTER:
                cues.append((state.get(CUE_TIME, 0), state.get(CUE_TRACK, 0), int.from_bytes(data[p:end], "big")))
            at = end
    except (ValueError, IndexError, struct.error):
        return Parsed(packets, tracks, cues, False)
    return Parsed(packets, tracks, cues, bool(data))


def element(kind: int, body: bytes) -> bytes:
    n = next(k for k in range(1, 9) if len(body) < (1 << 7 * k) - 1)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (len(body) | 1 << 7 * n).to_bytes(n, "big") + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def mux(payload: bytes) -> bytes:
    """A file with the payload, a multiple of 576 bytes, as 8-bit mono samples:
    fixed-size laces of 8 frames, clusters of 64 blocks, a cue per cluster."""
    step = FRAME // SAMPLES_PER_MS
    audio = element(AUDIO, element(RATE, struct.pack(">d", 1000.0 * SAMPLES_PER_MS)) + number(CHANNELS, 1) + number(DEPTH, 8))
    entry = number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(0x23E383, step * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio
    parts = [element(INFO, number(SCALE, 1_000_000)), element(TRACKS, element(ENTRY, entry))]
    place, points = sum(map(len, parts)), []
    per_block, per_cluster = LACE * FRAME, LACE * FRAME * BLOCKS_PER_CLUSTER
    for c in range(0, len(payload), per_cluster):
        time = c // FRAME * step
        body = [number(TIME, time)]
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            frames = payload[b : min(b + per_block, len(payload))]
            n = len(frames) // FRAME
            head = b"\x81" + struct.pack(">hB", (b - c) // FRAME * step, 0x84 if n > 1 else 0x80)
            body.append(element(SIMPLE, head + (bytes([n - 1]) if n > 1 else b"") + frames))
        parts.append(element(CLUSTER, b"".join(body)))
        points.append(element(POINT, number(CUE_TIME, time) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        place += len(parts[-1])
    parts.append(element(CUES, b"".join(points)))
    head = number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(parts))


def to_payload(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def read_payload(data: bytes, packets: list[Packet]) -> bytes:
    return b"".join(data[p.start : p.start + p.length] for p in packets)


def _batches(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for a in range(0, len(pdf), BATCH_ROWS):
        yield pdf.iloc[a : a + BATCH_ROWS]


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of docs (doc_id, text); doc_id as a string, which
    passes through tasks unchanged, also if null."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in _batches(whole):
                raw = [t.encode() for t in pdf["text"]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_bytes": [len(r) for r in raw], "media": [mux(to_payload(r)) for r in raw]})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInPandas(files, "doc_id string, n_bytes long, media binary")


def packets(files: DataFrame) -> DataFrame:
    """The packet table (doc_id, packet, track, timestamp, cluster, start, length,
    key) of files (doc_id, media)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in _batches(whole):
                out = [(doc, k, *p) for doc, media in zip(pdf["doc_id"], pdf["media"], strict=True) for k, p in enumerate(parse(media or b"").packets)]
                yield pd.DataFrame(out, columns=["doc_id", "packet", *Packet._fields])

    return files.select("doc_id", "media").mapInPandas(rows, "doc_id string, packet int, track int, timestamp long, cluster int, start long, length long, key boolean")


def features(files: DataFrame) -> DataFrame:
    """files with what is read back from them: payload digests and a feature
    string (packets, clusters, cues, duration in ms, checksum of samples, completeness)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in _batches(whole):
                out = []
                for doc, n, media in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                    media = media or b""
                    found = parse(media)
                    payload = read_payload(media, found.packets)
                    end = found.packets[-1].timestamp // 1_000_000 + FRAME // SAMPLES_PER_MS if found.packets else 0
                    told = f"packets={len(found.packets)};clusters={len({p.cluster for p in found.packets})};cues={len(found.cues)};ms={end};adler={zlib.adler32(payload)};complete={int(found.complete)}"
                    out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), told))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return files.mapInPandas(read, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(encode(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("doc_id", F.col("doc_id").cast("long"))
