"""Matroska files in a binary column: writing one audio track, and parsing any file into packet and cue tables.

The parser walks EBML elements of variable length (unknown sizes too), clusters, simple blocks and block groups, undoes Xiph, EBML and
fixed-size lacing and reads cues. It gives one packet per frame with its track, timestamp, byte range and the block it came from; the frames
themselves are cut from the file by Spark (``substring`` on the byte ranges) or by ``payloads``.

Cases: a null file is null; an empty, cut or broken file keeps the packets before the fault and says what was wrong in ``error``;
extra columns pass through; repeated files give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

# Element identifiers of the format.
EBML, SEGMENT, INFO, TIME_SCALE, TRACKS, TRACK_ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLE_RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, EBML, SEGMENT}

PACKET = "struct<cluster:int,block:int,track:int,time_ns:long,start:long,size:long,lacing:string,key:boolean>"
PARSED = f"struct<packets:array<{PACKET}>,tracks:array<struct<number:int,kind:int,codec:string,rate:double,depth:int>>,cues:array<struct<time_ns:long,track:int,cluster_start:long>>,error:string>"
FRAME, RATE = 576, 8000


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """An EBML size: as few bytes as hold it, or ``width``; all ones stay reserved for an unknown size."""
    while width < 9:
        if width and n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
        width += 1
    raise ValueError("too large for an EBML size")


def _element(ident: int, body: bytes) -> bytes:
    return _id(ident) + vint(len(body)) + body


def _number(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> tuple[int, bytes]:
    """Flag bits and the lacing head of a block with several frames; 1 Xiph, 2 fixed, 3 EBML."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == 2 and len(set(sizes)) == 1:
        return 0x04, head
    if kind == 1:
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    deltas = b""
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        deltas += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, head + vint(sizes[0]) + deltas


def write_audio(payload: bytes, frame: int = FRAME, rate: int = RATE, per_block: int = 4, per_cluster: int = 32) -> bytes:
    """A file with one 8-bit PCM track; ``frame`` bytes a packet, laced blocks of all kinds in turn, a cue for each cluster."""
    head = _element(EBML, b"".join([_number(VERSION, 1), _number(READ_VERSION, 1), _number(MAX_ID, 4), _number(MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _number(DOC_VERSION, 4), _number(DOC_READ, 2)]))
    audio = _element(AUDIO, _element(SAMPLE_RATE, struct.pack(">d", rate)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    track = _element(TRACK_ENTRY, b"".join([_number(TRACK_NUMBER, 1), _number(TRACK_UID, 1), _number(TRACK_TYPE, 2), _element(CODEC_ID, b"A_PCM/INT/LIT"), _number(DEFAULT_DURATION, frame * 10**9 // rate), audio]))
    parts = [_element(INFO, _number(TIME_SCALE, 10**6)), _element(TRACKS, track)]
    cues, at = [], sum(map(len, parts))
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    time = lambda k: k * frame * 1000 // rate
    for c in range(0, len(frames), per_block * per_cluster):
        body = [_number(TIMESTAMP, time(c))]
        for n, b in enumerate(range(c, min(c + per_block * per_cluster, len(frames)), per_block)):
            group = frames[b : min(b + per_block, c + per_block * per_cluster)]
            flags, lace = _lace(group, n % 3 + 1)
            offset = struct.pack(">h", time(b) - time(c))
            if n % 4 == 3:
                block = _element(BLOCK, b"".join([vint(1), offset, bytes([flags]), lace, *group]))
                body.append(_element(BLOCK_GROUP, block + _number(BLOCK_DURATION, len(group) * frame * 1000 // rate)))
            else:
                body.append(_element(SIMPLE_BLOCK, b"".join([vint(1), offset, bytes([flags | 0x80]), lace, *group])))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, time(c)) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        cluster = _element(CLUSTER, b"".join(body))
        parts.append(cluster)
        at += len(cluster)
    segment = b"".join([*parts, _element(CUES, b"".join(cues))])
    return head + _id(SEGMENT) + vint(len(segment), 8) + segment


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, position after it, and whether all its bits are ones (an unknown size)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no element at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    value = n & (1 << 7 * width) - 1
    return (n if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def _lace_sizes(data, at: int, end: int, kind: int) -> tuple[list[int], int]:
    count = data[at] + 1
    at += 1
    if kind == 2:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError(f"fixed lacing doesn't divide the block at byte {at}")
        return [size] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            value, after, _ = read_vint(data, at)
            n = value if k == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing runs past the block at byte {at}")
    return sizes, at


def parse(data: bytes) -> dict:
    """The packet, track and cue tables of one file, in file order."""
    view = memoryview(data)
    out: dict = {"packets": [], "tracks": [], "cues": [], "error": None}
    state = {"scale": 10**6, "segment": 0, "cluster": -1, "time": 0, "block": -1}
    lengths: dict[int, int] = {}  # a track's default duration
    try:
        _walk(view, 0, len(view), state, lengths, out)
        if not out["tracks"]:
            raise ValueError("no tracks")
    except (ValueError, IndexError) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def _walk(data, at: int, end: int, state: dict, lengths: dict, out: dict, inside: int = 0) -> int:
    while at < end:
        start = at
        ident, at, _ = read_vint(data, at, keep_marker=True)
        if inside == CLUSTER and ident in TOP:
            return start  # a cluster of unknown size ends where the next top element begins
        size, at, unknown = read_vint(data, at)
        stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element {ident:X} at byte {start} runs past byte {end}")
        if ident == SEGMENT:
            state["segment"] = at
        elif ident == CLUSTER:
            state["cluster"] += 1
            state["time"] = 0
        elif ident == TRACK_ENTRY:
            out["tracks"].append({"number": 0, "kind": 0, "codec": None, "rate": None, "depth": None})
        elif ident == CUE_POSITIONS:
            out["cues"].append({"time_ns": state.get("cue", 0), "track": 0, "cluster_start": 0})
        if ident in MASTERS or ident == AUDIO:
            reached = _walk(data, at, stop, state, lengths, out, ident if unknown else 0)
            at = reached if unknown else stop
            continue
        body = data[at:stop]
        if ident in (SIMPLE_BLOCK, BLOCK):
            _block(data, at, stop, ident == SIMPLE_BLOCK, state, lengths, out)
        elif ident in (CODEC_ID,):
            out["tracks"][-1]["codec"] = bytes(body).rstrip(b"\0").decode("latin-1")
        elif ident == SAMPLE_RATE:
            out["tracks"][-1]["rate"] = struct.unpack(">d" if len(body) == 8 else ">f", body)[0] if len(body) in (4, 8) else 0.0
        elif ident in (TIME_SCALE, TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, BIT_DEPTH, TIMESTAMP, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            n = int.from_bytes(body, "big")
            if ident == TIME_SCALE:
                state["scale"] = n
            elif ident == TIMESTAMP:
                state["time"] = n
            elif ident == CUE_TIME:
                state["cue"] = n * state["scale"]
            elif ident == CUE_TRACK:
                out["cues"][-1]["track"] = n
            elif ident == CUE_CLUSTER:
                out["cues"][-1]["cluster_start"] = state["segment"] + n
            elif ident == DEFAULT_DURATION:
                lengths[out["tracks"][-1]["number"]] = n
            else:
                out["tracks"][-1][{TRACK_NUMBER: "number", TRACK_TYPE: "kind", BIT_DEPTH: "depth"}[ident]] = n
        at = stop
    return at


def _block(data, at: int, stop: int, simple: bool, state: dict, lengths: dict, out: dict) -> None:
    track, at, _ = read_vint(data, at)
    offset, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    sizes, at = _lace_sizes(data, at, stop, kind) if kind else ([stop - at], at)
    state["block"] += 1
    time = (state["time"] + offset) * state["scale"]
    for k, n in enumerate(sizes):
        out["packets"].append((state["cluster"], state["block"], track, time + k * lengths.get(track, 0), at, n, ("none", "xiph", "fixed", "ebml")[kind], bool(flags & 0x80) or not simple))
        at += n


_PACKET_FIELDS = [("cluster", pa.int32()), ("block", pa.int32()), ("track", pa.int32()), ("time_ns", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("lacing", pa.string()), ("key", pa.bool_())]
_PARSED = pa.struct(
    [
        ("packets", pa.list_(pa.struct(_PACKET_FIELDS))),
        ("tracks", pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.int32()), ("codec", pa.string()), ("rate", pa.float64()), ("depth", pa.int32())]))),
        ("cues", pa.list_(pa.struct([("time_ns", pa.int64()), ("track", pa.int32()), ("cluster_start", pa.int64())]))),
        ("error", pa.string()),
    ]
)


def _parse_batch(files: pa.Array) -> pa.Array:
    """A column of files -> their packet, track and cue tables."""
    found = [parse(x.as_py()) if x.is_valid else None for x in files]
    flat = [p for x in found if x for p in x["packets"]]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(_PACKET_FIELDS)
    packets = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PACKET_FIELDS, strict=True)], fields=[pa.field(n, t) for n, t in _PACKET_FIELDS])
    offsets = [0]
    for x in found:
        offsets.append(offsets[-1] + (len(x["packets"]) if x else 0))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), packets)
    rest = [pa.array([x[k] if x else None for x in found], _PARSED.field(k).type) for k in ("tracks", "cues", "error")]
    return pa.StructArray.from_arrays([lists, *rest], fields=list(_PARSED), mask=pa.array([x is None for x in found]))


def _payload_batch(files: pa.Array, packets: pa.Array) -> pa.Array:
    """The frames of each file by their byte ranges, joined in file order."""
    starts, sizes = packets.flatten().field("start").to_numpy(), packets.flatten().field("size").to_numpy()
    ends = packets.value_lengths().fill_null(0).to_numpy().cumsum()
    out, a = [], 0
    for x, b in zip(files, ends, strict=True):
        data = x.as_buffer() if x.is_valid else None
        out.append(b"".join([data[s : s + n] for s, n in zip(starts[a:b].tolist(), sizes[a:b].tolist(), strict=True)]) if data is not None else None)
        a = b
    return pa.array(out, pa.binary())


def _audio_batch(texts: pa.Array) -> pa.Array:
    """Each text's bytes, filled up with 255 to a positive multiple of the frame, as a file of 8-bit samples."""
    out = []
    for x in texts.cast(pa.binary()):
        raw = x.as_py() or b""
        out.append(write_audio(raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME)))
    return pa.array(out, pa.binary())


def parse_file(content):
    return F.arrow_udf(_parse_batch, PARSED)(content)


def payloads(content, packets):
    return F.arrow_udf(_payload_batch, "binary")(content, packets)


def audio_of_text(text):
    return F.arrow_udf(_audio_batch, "binary")(text)


def parse_files(files: DataFrame, content: str = "content", out: str = "mkv") -> DataFrame:
    """``files`` with a struct column ``out``: packets, tracks, cues, error."""
    return files.withColumn(out, parse_file(F.col(content)))


def packet_table(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each packet: key, number, and the packet's columns; byte ranges refer to ``content``."""
    return parse_files(files.select(key, content), content, "__mkv").select(key, F.posexplode(F.col("__mkv")["packets"]).alias("number", "packet")).select(key, "number", "packet.*")


def cue_table(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each cue: key, time_ns, track, and the byte at which its cluster begins."""
    return parse_files(files.select(key, content), content, "__mkv").select(key, F.inline(F.col("__mkv")["cues"]))


def op1_matroska(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), audio_of_text("text").alias("media"))
    read = parse_files(stored, "media").withColumn("payload", payloads("media", F.col("mkv")["packets"]))
    p, size = F.col("mkv")["packets"], F.octet_length("payload")
    span = F.when(F.size(p) > 0, F.element_at(p, -1)["time_ns"]).otherwise(F.lit(0))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["lacing"]))), "+")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), size - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("packets="), F.size(p)), F.concat(F.lit("clusters="), F.size(F.array_distinct(F.transform(p, lambda x: x["cluster"])))), F.concat(F.lit("cues="), F.size(F.col("mkv")["cues"])), F.concat(F.lit("last_ns="), span), F.concat(F.lit("lacing="), kinds), F.concat(F.lit("error="), F.coalesce(F.col("mkv")["error"], F.lit("")))).alias("feature"),
    )


def brute_force(text: str | None) -> tuple:
    """The contract's digests straight from the text; for tests."""
    raw = (text or "").encode()
    payload = raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
