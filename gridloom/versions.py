"""Versions of what this package runs on."""

from __future__ import annotations

import importlib.metadata
import platform
import sys


def versions() -> dict[str, str]:
    out = {"python": sys.version.split()[0], "system": platform.platform()}
    for name in ("pyspark", "pyarrow", "numpy", "pandas", "duckdb", "pytest"):
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = "none"
    return out


def show_versions() -> None:
    width = max(map(len, versions()))
    for name, value in versions().items():
        print(f"{name:>{width}}: {value}")
