"""Configured sources: one JSON file each; roots come from the environment."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path


def natural(name: str) -> list:
    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", name)]


@dataclass(frozen=True)
class Source:
    name: str
    data_type: str = "xml_ocr"
    metadata: dict = field(default_factory=dict)
    loading: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)


class Registry:
    """Sources below ``data_root`` (or DATA_DIR) and results below ``results_root`` (or RESULTS_DIR)."""

    def __init__(self, data_root: str | None = None, results_root: str | None = None) -> None:
        self.data_root = Path(data_root or os.environ.get("DATA_DIR", "data"))
        self.results_root = Path(results_root or os.environ.get("RESULTS_DIR", "results"))

    def names(self) -> list[str]:
        return sorted((p.stem for p in (self.data_root / "sources").glob("*.json")), key=natural)

    def load(self, name: str) -> Source:
        path = self.data_root / "sources" / f"{name}.json"
        if not path.exists():
            raise ValueError(f"unknown source {name!r}; there are: {', '.join(self.names()) or 'none'}")
        raw = json.loads(path.read_text("utf-8"))
        return Source(raw.get("dataset_name", name), raw.get("data_type", "xml_ocr"), raw.get("metadata", {}), raw.get("loading", {}), raw.get("parts", []))

    def paths(self, name: str) -> dict[str, str]:
        return {
            "raw": str(self.data_root / "raw" / name), "lines": str(self.data_root / "raw" / name / "text" / f"{name}_lines.parquet"),
            "blocks": str(self.data_root / "raw" / name / "text" / "textblocks.parquet"), "images": str(self.data_root / "raw" / name / "images"),
            "ledger": str(self.data_root / "raw" / name / "text" / "read_files.parquet"), "downloads": str(self.data_root / "downloads" / name), "results": str(self.results_root / name),
        }

    def extraction_status(self, name: str, years: set[int]) -> dict[str, bool]:
        """Per part: whether any year of its range is there."""
        out = {}
        for part in self.load(name).parts:
            found = [int(y) for y in re.findall(r"\d{4}", str(part.get("years", "")))]
            span = range(found[0], found[-1] + 1) if found else range(0)
            out[part["name"]] = bool(years.intersection(span))
        return out
