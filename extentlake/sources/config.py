"""Configuration files (TOML): defaults, validation, lookups. Files are small and few; texts of many nodes are a column."""

from __future__ import annotations

import copy
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame

# The defaults of a configuration.
DEFAULTS = {
    "global": {"pool-name": "demo", "journal-path": "/var/lib/extentlake/journal.bin", "metadata-path": "/var/lib/extentlake/metadata.bin", "snapshot-interval-hours": 24},
    "server": {"socket-path": "/var/run/extentlake/extentlake.sock", "require-root-user": True, "read-timeout-seconds": 30, "idle-timeout-seconds": 300, "max-timeout-ms": 300000},
    "limits": {
        "max-request-size-bytes": 1 << 20, "max-write-size-bytes": 10 << 30, "write-rate-limit-per-second": 10, "write-burst": 20, "read-rate-limit-per-second": 50,
        "read-burst": 100, "max-goroutines": 64, "slow-query-threshold-ms": 5000,
    },
    "logging": {"level": "info", "json": True}, "audit": {"enabled": False, "path": "/var/log/extentlake/audit.log"}, "alert": {"enabled": False, "url": ""},
    "scrub": {"enabled": False, "interval-hours": 24, "start-hour": 2, "end-hour": 5},
    "disk-pool": {"num-disks": 4, "disk-size-bytes": 1 << 40, "extent-size-bytes": 64 << 20, "parity-segments": 2},
}


def parse(text: str) -> dict:
    """The settings of a file over the defaults; sections that the defaults lack are kept."""
    out = copy.deepcopy(DEFAULTS)
    for name, section in tomllib.loads(text).items():
        out[name] = out.get(name, {}) | section if isinstance(section, dict) else section
    return out


def error(config: dict) -> str | None:
    """The first thing wrong with a configuration."""
    g, limits = config["global"], config["limits"]
    if not g["pool-name"]:
        return "pool-name is required"
    if set(g["pool-name"]) & set("/\\:"):
        return "pool-name must not contain path separators"
    for section, key in (("global", "journal-path"), ("global", "metadata-path"), ("server", "socket-path")):
        if config[section][key] and not config[section][key].startswith("/"):
            return f"{key} must be absolute"
    for key in ("write-rate-limit-per-second", "read-rate-limit-per-second"):
        if limits[key] <= 0:
            return f"{key} must be positive"
    return None


def pool_paths(config: dict, name: str) -> tuple[str, str]:
    """Journal and metadata path of a named pool; those of the global section for any other."""
    for pool in config.get("pools", []):
        if pool.get("name") == name:
            return pool.get("journal-path", ""), pool.get("metadata-path", "")
    return config["global"]["journal-path"], config["global"]["metadata-path"]


def loaded(texts: DataFrame) -> DataFrame:
    """node, pool_name, read_timeout_ms, journal_path, error of configurations (node, pool, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for node, pool, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    c = parse(text)
                except tomllib.TOMLDecodeError:
                    rows.append((node, None, None, None, "parse config"))
                    continue
                wrong = error(c)
                rows.append((node, None, None, None, wrong) if wrong else (node, c["global"]["pool-name"], c["server"]["read-timeout-seconds"] * 1000, pool_paths(c, pool)[0], None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["node", "pool_name", "read_timeout_ms", "journal_path", "error"])

    return texts.select("node", "pool", "text").mapInArrow(run, "node long, pool_name string, read_timeout_ms long, journal_path string, error string")
