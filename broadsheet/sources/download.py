"""Getting archives and pictures: work of the driver or of a few tasks, outside the query engine."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import time
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path


def md5(path: str | Path, size: int = 1 << 20) -> str:
    h = hashlib.md5()
    with open(path, "rb") as f:
        while data := f.read(size):
            h.update(data)
    return h.hexdigest()


def fetch(url: str, target: str | Path, expected_md5: str | None = None, valid: Callable[[Path], bool] | None = None, retries: int = 3, delay: float = 1.0, timeout: float = 60.0) -> str:
    """Get a file: ``present`` if it is there and fine, else ``downloaded``; it appears under its name only when whole."""
    target = Path(target)
    fine = lambda p: (expected_md5 is None or md5(p) == expected_md5) and (valid is None or valid(p))
    if target.exists() and fine(target):
        return "present"
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:
                shutil.copyfileobj(source, out)
            if not fine(part):
                raise OSError(f"{url}: what came is damaged")
            os.replace(part, target)
            return "downloaded"
        except OSError:
            part.unlink(missing_ok=True)
            if attempt + 1 == retries:
                raise
            time.sleep(delay * (attempt + 1))
    raise ValueError("retries must be at least 1")


def fetch_all(jobs: Iterable[tuple[str, str]], workers: int = 4, **options) -> dict[str, int]:
    """Get (url, target) pairs in parallel; failures are counted and don't stop the others."""

    def one(job: tuple[str, str]) -> str:
        try:
            return fetch(*job, **options)
        except OSError:
            return "failed"

    with ThreadPoolExecutor(workers) as pool:
        results = list(pool.map(one, jobs))
    return {k: results.count(k) for k in ("downloaded", "present", "failed")} | {"total": len(results)}


def unpack(archive: str | Path, target: str | Path) -> int:
    """Unpack a tar archive; folders named like years are merged with those that are there.  Returns the files' number."""
    target = Path(target)
    target.mkdir(parents=True, exist_ok=True)
    with tarfile.open(archive) as tar:
        members = [m for m in tar.getmembers() if m.isfile()]
        tar.extractall(target, members=members, filter="data")
    # archives may hold one folder around the years
    for year in sorted(target.glob("*/[0-9][0-9][0-9][0-9]")):
        for path in sorted(p for p in year.rglob("*") if p.is_file()):
            place = target / path.relative_to(year.parent)
            place.parent.mkdir(parents=True, exist_ok=True)
            os.replace(path, place)
        shutil.rmtree(year)
        if not any(year.parent.iterdir()):
            year.parent.rmdir()
    return len(members)


def relocate_issue(root: str | Path, old: str, new: str, rewrites: dict[str, str] | None = None) -> int:
    """Move an issue filed under a wrong date, as 1900/01/02/01 to 1902/01/02/01, and put its texts right.

    The dates in file names and, besides ``rewrites``, in the XML are replaced.  Returns the number of files; 0 if there
    is no such folder.
    """
    source, target = Path(root) / old, Path(root) / new
    if not source.is_dir():
        return 0
    dates = ["-".join(p.split("/")[:3]) for p in (old, new)]
    german = [".".join(reversed(d.split("-"))) for d in dates]
    pairs = [(dates[0], dates[1]), (german[0], german[1]), *(rewrites or {}).items()]
    count = 0
    for path in sorted(p for p in source.rglob("*") if p.is_file()):
        place = target / path.relative_to(source).parent / path.name.replace(dates[0], dates[1])
        place.parent.mkdir(parents=True, exist_ok=True)
        if path.suffix == ".xml":
            text = path.read_text("utf-8")
            for a, b in pairs:
                text = text.replace(a, b)
            place.write_text(text, "utf-8")
            path.unlink()
        else:
            os.replace(path, place)
        count += 1
    shutil.rmtree(source)
    return count
