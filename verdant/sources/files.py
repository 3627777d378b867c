"""Driver-side listings and texts of a site's folder.

Spark's own file sources skip empty files and names that begin with a dot or
an underscore, which a site has, so the driver walks the folder.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

INVENTORY = "path string, ext string, n_bytes long, size_mb double, pos int"
TEXT_EXT = {"qmd", "rmd", "md", "r", "css", "scss", "html", "js", "yml"}


def _walk(root: str, ignored: Iterable[str] = ()) -> list[str]:
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in set(ignored) and not d.endswith("_files")) if ignored else sorted(dirs)
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in sorted(names)]
    return sorted(found)


def inventory(spark: SparkSession, root: str, ignored: Iterable[str] = ()) -> DataFrame:
    """(path, ext, n_bytes, size_mb, pos) of all files but those in ignored folders."""
    rows = []
    for i, p in enumerate(_walk(root, ignored)):
        n = os.path.getsize(os.path.join(root, p))
        rows.append((p, p.rpartition(".")[2].lower() if "." in p.rpartition("/")[2] else "", n, n / 1024**2, i))
    return spark.createDataFrame(rows, INVENTORY)


def folders(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(os.path.relpath(d, root).replace(os.sep, "/"),) for d, _, _ in os.walk(root) if d != root], "path string")


def texts(spark: SparkSession, root: str, ignored: Iterable[str] = (), exts: set[str] = TEXT_EXT) -> DataFrame:
    """(file, text) of text sources; a file that can't be read is an empty text."""

    def read(path: str) -> str:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return "\n".join(f.read().splitlines())
        except OSError:
            return ""

    rows = [(p, read(os.path.join(root, p))) for p in _walk(root, ignored) if p.rpartition(".")[2].lower() in exts]
    return spark.createDataFrame(rows, "file string, text string")


def photos(spark: SparkSession, root: str, exts: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "gif")) -> DataFrame:
    """(folder, file) of the images under a root, hidden ones left out."""
    rows = [(p.rpartition("/")[0], p.rpartition("/")[2]) for p in _walk(root) if p.lower().endswith(tuple(f".{e}" for e in exts)) and not p.rpartition("/")[2].startswith(".")]
    return spark.createDataFrame(rows, "folder string, file string")


def find_up(name: str, start: str = ".", most: int = 8) -> str | None:
    """The first of start and its parents, up to ``most``, that has ``name``."""
    here = os.path.abspath(start)
    for _ in range(most + 1):
        if os.path.exists(os.path.join(here, name)):
            return os.path.join(here, name)
        here = os.path.dirname(here)
    return None


def find_first(paths: Iterable[str]) -> str | None:
    return next((p for p in paths if os.path.exists(p)), None)


def input_paths(name: str, states: tuple[str, ...] = ("_validado", "_tratado", ""), places: tuple[str, ...] = ("_input_data", "../_input_data", "conservacao/_input_data")) -> list[str]:
    """Where an input may lie, validated before treated before raw, each in several places."""
    return [f"{p}/{name}{s}.xlsx" for s in states for p in places]


def apply_moves(plan: list[tuple[str, str]], root: str, dry_run: bool = True) -> list[tuple[str, str, bool]]:
    """Moves (from, to) under a root unless it's a dry run; returns (from, to, done)."""
    out = []
    for old, new in plan:
        source, target = os.path.join(root, old), os.path.join(root, new)
        done = not dry_run and os.path.exists(source)
        if done:
            os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
            shutil.move(source, target)
        out.append((old, new, done))
    return out


def apply_fixes(root: str, files: list[str], fixes: list[tuple[str, str]], backup: str, dry_run: bool = True) -> list[tuple[str, bool, bool]]:
    """Literal replacements in files, kept in a backup folder first; returns (file, changed, written)."""
    out = []
    for name in files:
        path = os.path.join(root, name)
        if not os.path.exists(path):
            continue
        with open(path, encoding="utf-8") as f:
            text = f.read()
        new = text
        for old, by in fixes:
            new = new.replace(old, by)
        write = new != text and not dry_run
        if write:
            copy = os.path.join(root, backup, name)
            os.makedirs(os.path.dirname(copy), exist_ok=True)
            shutil.copy2(path, copy)
            with open(path, "w", encoding="utf-8") as f:
                f.write(new)
        out.append((name, new != text, write))
    return out
