"""Binary layouts of the pool: catalog snapshot, journal, progress files. All integers are big-endian.

A layout is a list of typed fields; one interpreter reads and writes all of them. Kinds: ``s`` text with a 16-bit length,
``S`` a 16-bit count of such, ``q`` ``i`` ``I`` ``B`` integers of 64, 32, 32 unsigned and 8 bits, ``?`` a flag byte,
``o`` an optional 64-bit integer behind a presence byte.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..functions.blake3 import blake3, blake3_list


class FormatError(ValueError):
    """A file that is no such file, or that was changed after it was written."""


def layout(spec: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in spec.split()]


# Fixed values of the formats.
SNAPSHOT_MAGIC, SNAPSHOT_VERSION, JOURNAL_MAGIC, JOURNAL_VERSION, REBUILD_MAGIC, SCRUB_MAGIC = b"RTPM", 2, b"RTPJ", 1, b"RBLD", b"SCRB"
HEADER, MAX_RECORD = 72, 64 * 1024 * 1024
ROLE_CODES = {"data": 1, "parity": 2, "metadata": 3}
STATE_CODES = {"prepared": 1, "data-written": 2, "parity-written": 3, "metadata-written": 4, "committed": 5, "aborted": 6, "replay-required": 7}
REPAIR_EXTENT, REPAIR_PARITY, META_SCRUB, META_REBUILD = "repair://extent/", "repair://parity/", "metadata://scrub/", "metadata://rebuild/"

POOL_V1 = layout("pool_id:s name:s version:s extent_size_bytes:q parity_mode:s created_ns:q")
POOL = layout("pool_id:s name:s version:s extent_size_bytes:q parity_mode:s filesystem_type:s sleep_enabled:? sleep_timeout_sec:I sleep_min_active_sec:I created_ns:q")
POOL_DEFAULTS = {"filesystem_type": "btrfs", "sleep_enabled": False, "sleep_timeout_sec": 300, "sleep_min_active_sec": 60}
DISK = layout("disk_id:s uuid:s role:B filesystem_type:s mountpoint:s capacity_bytes:q free_bytes:q health_status:s generation:q")
FILE_SHORT = layout("file_id:s path:s size_bytes:q mtime_ns:q ctime_ns:q policy:s state:s")
FILE = FILE_SHORT + layout("file_type:q mode:q link_target:s dev_major:q dev_minor:q")
EXTENT_SHORT = layout("extent_id:s file_id:s logical_offset:q length:q data_disk_id:s relative_path:s offset_bytes:q length_bytes:q checksum:s checksum_alg:s generation:q parity_group_id:s state:s")
EXTENT = EXTENT_SHORT + layout("compression_alg:s compressed_size:q")
GROUP = layout("parity_group_id:s parity_disk_id:s member_extent_ids:S parity_checksum:s generation:q")
TRANSACTION = layout("tx_id:s state:s started_ns:q committed_ns:o affected_extent_ids:S old_generation:q new_generation:q replay_required:?")
SCRUB_RUN = layout("run_id:s started_ns:q completed_ns:q repair:? healthy:? files_checked:i extents_checked:i parity_groups_checked:i healed_count:i failed_count:i issue_count:i healed_extent_ids:S healed_parity_group_ids:S")
RECORD = layout("tx_id:s pool_name:s logical_path:s affected_extent_ids:S")
#: The lists of a snapshot, in file order.
TABLES = {"disks": DISK, "files": FILE, "extents": EXTENT, "parity_groups": GROUP, "transactions": TRANSACTION, "scrub_history": SCRUB_RUN}

DDL = {"s": "string", "S": "array<string>", "q": "bigint", "i": "int", "I": "bigint", "B": "string", "?": "boolean", "o": "bigint"}


def ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {DDL[k]}" for n, k in fields)


_FIXED = {k: (f">{k}", struct.calcsize(f">{k}")) for k in "qiIB?"}
_SHORT = ">H"


@dataclass
class Cursor:
    data: bytes
    at: int = 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError(f"{n} bytes are wanted at {self.at}, the file has {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def count(self) -> int:
        return struct.unpack(_SHORT, self.take(2))[0]

    def value(self, kind: str):
        if kind == "s":
            return self.take(self.count()).decode()
        if kind == "S":
            return [self.value("s") for _ in range(self.count())]
        if kind == "o":
            return self.value("q") if self.take(1) == b"\1" else None
        fixed, size = _FIXED[kind]
        return struct.unpack(fixed, self.take(size))[0]

    def row(self, fields) -> dict:
        return {name: self.value(kind) for name, kind in fields}

    def rows(self, fields) -> list[dict]:
        return [self.row(fields) for _ in range(self.count())]


def put(kind: str, v) -> bytes:
    if kind == "s":
        raw = v.encode()
        if len(raw) > 65535:
            raise FormatError(f"a text of {len(raw)} bytes is beyond the format's 65535")
        return struct.pack(_SHORT, len(raw)) + raw
    if kind == "S":
        return count(v) + b"".join(put("s", x) for x in v)
    if kind == "o":
        return b"\0" if v is None else b"\1" + put("q", v)
    return struct.pack(_FIXED[kind][0], v)


def count(items) -> bytes:
    if len(items) > 65535:
        raise FormatError(f"{len(items)} entries are beyond the format's 65535")
    return struct.pack(_SHORT, len(items))


def put_row(fields, row: dict) -> bytes:
    return b"".join(put(k, row[n]) for n, k in fields)


_ROLES = {v: k for k, v in ROLE_CODES.items()}


def digested(data: bytes) -> list[bytes]:
    """The parts of a file that its reader wants the digests of, found by its magic; of a damaged one as many as there are."""
    for magic, start in ((SNAPSHOT_MAGIC, HEADER), (REBUILD_MAGIC, 48), (SCRUB_MAGIC, 53)):
        if data[:4] == magic:
            return [data[start:]]
    out, at = [], 0
    while at + 4 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        if not HEADER <= size <= MAX_RECORD or at + 4 + size > len(data):
            break
        out.append(data[at + 4 : at + 44] + data[at + 76 : at + 4 + size])
        at += 4 + size
    return out


def digests_of(files: list[bytes]) -> Callable[[bytes], bytes]:
    """A function that gives the digests that the readers of these files want; they are computed here, all at once."""
    parts = [part for data in files for part in digested(data)]
    known = dict(zip(parts, blake3_list(parts)))
    return lambda part: known[part] if part in known else blake3(part)


def read_snapshot(data: bytes, digest: Callable[[bytes], bytes] = blake3) -> dict:
    """{"pool": row, "disks": rows, ..., "saved_ns": time}; version 1 is brought up with its defaults."""
    if len(data) < HEADER or data[:4] != SNAPSHOT_MAGIC:
        raise FormatError("no snapshot")
    version, saved, size = struct.unpack_from(">H", data, 4)[0], struct.unpack_from(">q", data, 8)[0], struct.unpack_from(">I", data, 24)[0]
    payload = data[HEADER:]
    if version not in (1, SNAPSHOT_VERSION):
        raise FormatError(f"snapshot version {version}")
    if len(payload) != size:
        raise FormatError(f"the payload has {len(payload)} bytes, the header says {size}")
    if digest(payload) != data[40:HEADER]:
        raise FormatError("snapshot checksum")
    c = Cursor(payload)
    out = {"saved_ns": saved, "pool": POOL_DEFAULTS | c.row(POOL_V1 if version == 1 else POOL)}
    for name, fields in TABLES.items():
        out[name] = c.rows(fields)
    for d in out["disks"]:
        d["role"] = _ROLES.get(d["role"], "data")
    return out


def _snapshot_payload(state: dict) -> bytes:
    parts = [put_row(POOL, POOL_DEFAULTS | state["pool"])]
    for name, fields in TABLES.items():
        rows = state.get(name, [])
        if name == "disks":
            rows = [r | {"role": ROLE_CODES.get(r["role"], 1)} for r in rows]
        parts += [count(rows), *(put_row(fields, r) for r in rows)]
    return b"".join(parts)


def _snapshot(payload: bytes, digest: bytes, saved_ns: int) -> bytes:
    return SNAPSHOT_MAGIC + struct.pack(">HHqqIIq", SNAPSHOT_VERSION, 0, saved_ns, 0, len(payload), 0, 0) + digest + payload


def write_snapshot(state: dict, saved_ns: int) -> bytes:
    """The roles ``mirror`` and ``data`` share a code, as the format has none for the former."""
    payload = _snapshot_payload(state)
    return _snapshot(payload, blake3(payload), saved_ns)


def write_snapshots(states: list[dict], saved_ns: int) -> list[bytes]:
    """Many snapshots; their digests are computed at once."""
    payloads = [_snapshot_payload(state) for state in states]
    return [_snapshot(p, d, saved_ns) for p, d in zip(payloads, blake3_list(payloads))]


_STATES = {v: k for k, v in STATE_CODES.items()}


def read_journal(data: bytes, drop_torn_tail: bool = True, digest_of: Callable[[bytes], bytes] = blake3) -> Iterator[dict]:
    """Records in file order with ``seq`` from 0. A record cut short at the end is dropped (or an error); any other damage is
    an error."""
    at = seq = 0
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0] if at + 4 <= len(data) else 0
        if size > MAX_RECORD:
            raise FormatError(f"record {seq} claims {size} bytes")
        if size < HEADER or at + 4 + size > len(data):
            if drop_torn_tail:
                return
            raise FormatError(f"record {seq} is torn")
        head, digest, payload = data[at + 4 : at + 44], data[at + 44 : at + 76], data[at + 76 : at + 4 + size]
        if head[:4] != JOURNAL_MAGIC:
            raise FormatError(f"record {seq}: magic")
        if digest_of(head + payload) != digest:
            raise FormatError(f"record {seq}: checksum")
        state, ts, old, new, length = head[6], *struct.unpack_from(">qqqI", head, 8)
        if length != len(payload) or state not in _STATES:
            raise FormatError(f"record {seq}: length or state")
        c = Cursor(payload)
        row = {"seq": seq, "state": _STATES[state], "ts_ns": ts, "old_generation": old, "new_generation": new, "record_checksum": digest.hex()}
        row |= c.row(RECORD)
        row["file"] = c.row(FILE_SHORT) if c.take(1) == b"\1" else None
        row["extents"] = c.rows(EXTENT_SHORT)
        yield row
        at, seq = at + 4 + size, seq + 1


def _record(row: dict) -> tuple[bytes, bytes]:
    payload = put_row(RECORD, row)
    payload += b"\0" if row["file"] is None else b"\1" + put_row(FILE_SHORT, row["file"])
    payload += count(row["extents"]) + b"".join(put_row(EXTENT_SHORT, e) for e in row["extents"])
    return JOURNAL_MAGIC + struct.pack(">HBBqqqII", JOURNAL_VERSION, STATE_CODES[row["state"]], 0, row["ts_ns"], row["old_generation"], row["new_generation"], len(payload), 0), payload


def _framed(head: bytes, payload: bytes, digest: bytes) -> bytes:
    return struct.pack(">I", HEADER + len(payload)) + head + digest + payload


def write_record(row: dict) -> bytes:
    head, payload = _record(row)
    return _framed(head, payload, blake3(head + payload))


def write_records(rows: list[dict]) -> list[bytes]:
    """Many records; their digests are computed at once."""
    records = [_record(row) for row in rows]
    return [_framed(*r, d) for r, d in zip(records, blake3_list([head + payload for head, payload in records]))]


def read_rebuild_progress(data: bytes, digest: Callable[[bytes], bytes] = blake3) -> dict:
    if data[:4] != REBUILD_MAGIC or len(data) < 48 or digest(data[48:]) != data[16:48]:
        raise FormatError("rebuild progress")
    n, ts = struct.unpack_from(">Iq", data, 4)
    c = Cursor(data, 48)
    return {"updated_ns": ts, "completed_extents": [c.value("s") for _ in range(n)]}


def write_rebuild_progress(ids: list[str], updated_ns: int) -> bytes:
    payload = b"".join(put("s", i) for i in ids)
    return REBUILD_MAGIC + struct.pack(">Iq", len(ids), max(0, updated_ns)) + blake3(payload) + payload


def read_scrub_progress(data: bytes, digest: Callable[[bytes], bytes] = blake3) -> dict:
    if data[:4] != SCRUB_MAGIC or len(data) < 53 or digest(data[53:]) != data[21:53]:
        raise FormatError("scrub progress")
    flags, n, m, ts = struct.unpack_from(">BIIq", data, 4)
    c = Cursor(data, 53)
    return {"repair": bool(flags & 1), "updated_ns": ts, "completed_extents": [c.value("s") for _ in range(n)], "completed_parity_groups": [c.value("s") for _ in range(m)]}


def write_scrub_progress(repair: bool, extents: list[str], groups: list[str], updated_ns: int) -> bytes:
    payload = b"".join(put("s", i) for i in [*extents, *groups])
    return SCRUB_MAGIC + struct.pack(">BIIq", repair, len(extents), len(groups), max(0, updated_ns)) + blake3(payload) + payload
