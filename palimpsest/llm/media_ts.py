"""Media columns (operator 2): payloads in MPEG transport streams, and back.

A stream has one program: a program association table (PID 0), a program map table (PID 0x100) and one elementary
stream (PID 0x101, private data). An access unit of UNIT bytes at most is one elementary packet with a presentation timestamp; every
GOP-th starts a random-access point, marked in the adaptation field with a clock reference.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

PACKET, BODY, PAT_PID, PMT_PID, ES_PID, STREAM_TYPE = 188, 184, 0, 0x100, 0x101, 0x06
PAD, UNIT, GOP, TICKS = 576, 576 * 14, 4, 3600  # TICKS: of the 90 kHz clock between access units
WRAP = 1 << 33  # timestamps have 33 bits


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, b"\0\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
)


def _stamp(t: int) -> bytes:
    t %= WRAP
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes, unit: int = UNIT, gop: int = GOP) -> bytes:
    """payload: one or more bytes."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        pes = b"\0\0\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + data
        field = b""
        if k % gop == 0:  # random access, with a clock reference (base, six reserved bits, extension 0)
            field = b"\x50" + (k * TICKS % WRAP << 15 | 0x7E00).to_bytes(6, "big")
        first = BODY - (len(field) + 1 if field else 0)
        rest = max(0, len(pes) - first)
        n = 1 + -(-rest // BODY)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n) & 15)
        counter += n
        body, a = np.frombuffer(pes, np.uint8), 0
        last = len(pes) if n == 1 else rest - (n - 2) * BODY
        if n > 2:
            packets[1:-1, 4:] = body[first : first + (n - 2) * BODY].reshape(-1, BODY)
        for i in {0, n - 1}:
            size = (len(pes) if n == 1 else first) if i == 0 else last
            a = 0 if i == 0 else len(pes) - size
            stuff = BODY - size
            if stuff:  # an adaptation field fills what the data leave
                packets[i, 3] |= 0x20
                packets[i, 4] = stuff - 1
                flags = field if i == 0 and field else b"\0" * min(1, stuff - 1)
                packets[i, 5 : 5 + len(flags)] = np.frombuffer(flags, np.uint8)
            packets[i, PACKET - size :] = body[a : a + size]
        out.append(packets.tobytes())
    return b"".join(out)


def demux(media: bytes) -> dict:
    """payload, pts (of each access unit), random_access (its indexes), packets, continuity_errors, pmt_pid, es_pid, stream_type.

    The program is the first that the association table names (number 0 stands for network information). A packet that repeats the one
    before it is left out, as the format allows one repetition; a jump of the counter that the discontinuity indicator announces is no error.
    ValueError: lost sync, a table missing or damaged, or an elementary packet damaged.
    """
    if not media or len(media) % PACKET:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pids = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    start = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)

    def table(pid: int) -> bytes:
        found = np.flatnonzero((pids == pid) & (p[:, 1] & 0x40 > 0) & (control & 1 == 1))
        if not len(found):
            raise ValueError("no table")
        i = int(found[0])
        b = p[i, start[i] :].tobytes()
        b = b[1 + b[0] :]
        b = b[: 3 + (int.from_bytes(b[1:3], "big") & 0xFFF)]
        if crc_mpeg(b):
            raise ValueError("damaged table")
        return b

    pat = table(PAT_PID)
    programs = [pat[k : k + 4] for k in range(8, len(pat) - 4, 4) if pat[k : k + 2] != b"\0\0"]
    if not programs:
        raise ValueError("no program")
    pmt_pid = int.from_bytes(programs[0][2:], "big") & 0x1FFF
    pmt = table(pmt_pid)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    es_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    own = np.flatnonzero((pids == es_pid) & (control & 1 == 1))
    again = np.zeros(len(own), bool)
    again[1:] = (p[own[1:]] == p[own[:-1]]).all(1)
    own = own[~again]
    counter = p[own, 3] & 15
    told = (control[own] & 2 > 0) & (p[own, 4] > 0) & (p[own, 5] & 0x80 > 0)
    errors = int((((counter[1:] - counter[:-1]) % 16 != 1) & ~told[1:]).sum())
    begins = np.flatnonzero(p[own, 1] & 0x40)
    out, pts, access = [], [], []
    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(own)][: len(begins)], strict=True)):
        rows = own[a:b]
        whole = [p[rows[0], start[rows[0]] :].tobytes()]
        if len(rows) > 2:
            plain = control[rows[1:-1]] == 1
            whole.append(p[rows[1:-1], 4:].tobytes() if plain.all() else b"".join(p[i, start[i] :].tobytes() for i in rows[1:-1]))
        if len(rows) > 1:
            whole.append(p[rows[-1], start[rows[-1]] :].tobytes())
        pes = b"".join(whole)
        if pes[:3] != b"\0\0\x01" or len(pes) != 6 + int.from_bytes(pes[4:6], "big"):
            raise ValueError("damaged elementary packet")
        pts.append(_read_stamp(pes[9:14]) if pes[7] & 0x80 else None)
        if control[rows[0]] & 2 and p[rows[0], 4] and p[rows[0], 5] & 0x40:
            access.append(k)
        out.append(pes[9 + pes[8] :])
    return {"payload": b"".join(out), "pts": pts, "random_access": access, "packets": len(p), "continuity_errors": errors, "pmt_pid": pmt_pid, "es_pid": es_pid, "stream_type": pmt[at]}


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) as UTF-8, padded with bytes 255 to a positive multiple of 576."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batch: pa.RecordBatch) -> dict:
        raw = [t.encode() for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [*map(len, raw)], "media": [mux(b.ljust(max(1, -(-len(b) // PAD)) * PAD, b"\xff")) for b in raw]}

    return common.map_batches(common.texts(docs), rows, schema, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Of (doc_id, n_bytes, media): payload, its stream's timestamps, random-access points and facts.

    A null or damaged stream gives a row with its error, media_bytes and media_sha256 where there are bytes, and null elsewhere."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32())), ("error", pa.string())])
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>, error string"

    def rows(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in schema.names} | {"doc_id": batch.column(0), "n_bytes": batch.column(1)}
        for m in batch.column(2):
            m = m.as_py()
            try:
                x = demux(m or b"")
            except (ValueError, IndexError) as e:
                known = {"media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()} if m is not None else {}
                known["error"] = str(e) if isinstance(e, ValueError) else "cut short"
                for n in schema.names[2:]:
                    out[n].append(known.get(n))
                continue
            feature = f"packets={x['packets']};units={len(x['pts'])};random_access={len(x['random_access'])};last_pts={x['pts'][-1] if x['pts'] else None};continuity_errors={x['continuity_errors']};type={x['stream_type']}"
            for n, v in (("payload_bytes", len(x["payload"])), ("payload_sha256", hashlib.sha256(x["payload"]).hexdigest()), ("tail_crc32", zlib.crc32(x["payload"][-32:])), ("media_bytes", len(m)), ("media_sha256", hashlib.sha256(m).hexdigest()), ("feature", feature), ("pts", x["pts"]), ("random_access", x["random_access"]), ("error", None)):
                out[n].append(v)
        return out

    return common.map_batches(media.select("doc_id", "n_bytes", "media"), rows, schema, ddl)


def op2_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pts, random_access, error, of the stored
    streams, which are written to the shared folder and read back."""
    return from_media(common.written(to_media(common.documents(spark, sf_dir)), common.shared_folder(spark)))
