"""Column functions: enums, names, paths, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model (enumerations and thresholds).
ROLES = ("data", "parity", "mirror", "metadata")
STATES = ("prepared", "data-written", "parity-written", "metadata-written", "committed", "aborted", "replay-required")
TRANSITIONS = (
    ("prepared", "data-written"), ("prepared", "aborted"), ("prepared", "replay-required"),
    ("data-written", "parity-written"), ("data-written", "aborted"), ("data-written", "replay-required"),
    ("parity-written", "metadata-written"), ("parity-written", "replay-required"),
    ("metadata-written", "committed"), ("metadata-written", "replay-required"),
    ("replay-required", "committed"), ("replay-required", "aborted"),
)
REPAIR_TRANSITIONS = (
    ("prepared", "data-written"), ("prepared", "replay-required"),
    ("data-written", "committed"), ("data-written", "replay-required"),
    ("replay-required", "committed"), ("replay-required", "aborted"),
)
LATENCY_BOUNDS_US = (1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000)
FILE_TYPES = ((0xA000, "symlink"), (0x4000, "directory"), (0x1000, "fifo"), (0xC000, "socket"), (0x6000, "block"), (0x2000, "char"))
SMART_IDS = ((5, "reallocated"), (197, "pending"), (198, "uncorrectable"), (194, "celsius"), (200, "read_errors"), (201, "write_errors"), (9, "hours"))


def is_transition(before: Column, after: Column, table=TRANSITIONS) -> Column:
    return F.concat_ws(">", before, after).isin(*[f"{a}>{b}" for a, b in table])


def file_type(mode: Column) -> Column:
    kind = mode.bitwiseAND(F.lit(0xF000))
    out = F.when(F.lit(False), "")
    for bits, name in FILE_TYPES:
        out = out.when(kind == bits, name)
    return out.otherwise("regular")


def protection_level(state: Column) -> Column:
    return F.when(state == "", "integrity_only").otherwise(state)


def extent_class(protection: Column) -> Column:
    """An empty class means that the extent has a checksum alone."""
    return F.when(protection == "", "checksum_only").otherwise(protection)


def numbered(prefix: str, number: Column) -> Column:
    """``prefix-000042``; longer numbers are not cut."""
    return F.format_string(f"{prefix}-%06d", number)


def extent_path(path: Column, number: Column) -> Column:
    """Two directory levels from the digest of the logical path."""
    d = F.sha2(path, 256)
    return F.concat(F.lit("data/"), F.substring(d, 1, 2), F.lit("/"), F.substring(d, 3, 2), F.lit("/"), numbered("extent", number), F.lit(".bin"))


def sanitized_disk(disk: Column) -> Column:
    """Every byte outside of ``[A-Za-z0-9_-]`` becomes ``_``; an empty id is ``_``."""
    latin = F.decode(disk.cast("binary"), "ISO-8859-1")
    return F.when(disk == "", "_").otherwise(F.regexp_replace(latin, "[^A-Za-z0-9_-]", "_"))


def direct_child(prefix: str, path: Column) -> tuple[Column, Column]:
    """Name of the direct child of ``prefix`` that ``path`` leads to ('' if none), and whether more follows."""
    base = F.when(path.startswith(prefix + "/"), F.substring(path, len(prefix) + 2, 2**31 - 1)).otherwise("") if prefix else F.regexp_replace(path, "^/", "")
    return F.substring_index(base, "/", 1), F.instr(base, "/") > 0


def bucket_index(value: Column, bounds=LATENCY_BOUNDS_US) -> Column:
    """Number of bounds at or below the value: a value equal to a bound falls into the next bucket."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value))


def smart_violation(a: dict[str, Column]) -> Column:
    """The first rule that a device breaks; null if none."""
    return (
        F.when(a["reallocated"] > 100, "reallocated").when(a["pending"] > 50, "pending").when(a["uncorrectable"] > 0, "uncorrectable")
        .when(a["celsius"] > 60, "celsius").when((a["read_errors"] > 1_000_000) | (a["write_errors"] > 1_000_000), "error_rate")
    )


def smart_attribute(report: Column, attribute_id: int) -> Column:
    """Last value of an attribute in a report of ``"id":N,"name":"...","value":N`` entries; 0 if there is none."""
    found = F.regexp_extract_all(report, F.lit(rf'"id":{attribute_id},"name":"\w+","value":(\d+)'), 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("long"), F.lit(0))


def is_healthy(status: Column) -> Column:
    return status.isin("ok", "suspect")


def mirror_path(root: Column, path: Column, disk: Column) -> Column:
    """Where the copy of a blob lies: below the mirror's folder, with the extension once more behind ``.mirror``."""
    return F.concat_ws("/", root, F.lit("mirror"), disk, F.concat(path, F.lit(".mirror"), F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def relocated_path(path: Column, disk: Column) -> Column:
    """The path with its two folders named after the disk; paths of fewer than four parts stay."""
    parts = F.split(path, "/")
    moved = F.concat(F.slice(parts, 1, 1), F.array(F.substring(disk, 1, 2), F.substring(disk, 3, 2)), F.slice(parts, F.lit(4), F.size(parts)))
    return F.when(F.size(parts) >= 4, F.array_join(moved, "/")).otherwise(path)


def tx_id(prefix: str, number: Column) -> Column:
    """A transaction's id; the number is the caller's, so that a repeated run gives the same ids."""
    return F.concat(F.lit(f"{prefix}-"), number.cast("string"))


def contains_any(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "") != text


def milliseconds(seconds: Column) -> Column:
    return seconds * 1000


def joined_errors(current: Column, following: Column) -> Column:
    return F.when(current == "", following).otherwise(F.concat_ws("; ", current, following))


def health_status(draining: Column, admission: Column) -> Column:
    return F.when(draining, "draining").when(admission == "refuse", "error").when(admission == "degraded", "degraded").otherwise("ok")


def extent_path_blake3(path: Column, number: Column) -> Column:
    """As ``extent_path``, with the digest that blobs on disk are named by."""
    from .blake3 import blake3_hex

    h = blake3_hex(path.cast("binary"))
    return F.concat(F.lit("data/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.format_string("/extent-%06d.bin", number))
