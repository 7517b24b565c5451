"""Sinks of small reports and of what is known about a run."""

from __future__ import annotations

import csv
import io
import subprocess
import time
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from briefmill.functions.ids import config_hash
from briefmill.operators.report import markdown_table
from briefmill.sources import files
from briefmill.sources.jsonl import write_document, write_settings


def write_csv(df: DataFrame, folder: str) -> None:
    """One CSV file with a header; for reports of few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_csv_file(rows: list[dict[str, Any]], columns: list[str], path: str | Path) -> None:
    """A small table as one CSV file of a known name."""
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, columns, extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    files.write_text(out.getvalue(), path)


def write_report(title: str, tables: dict[str, tuple[list[dict[str, Any]], list[str]]], path: str | Path) -> None:
    """A Markdown report with a pipe table for each section."""
    parts = [f"# {title}", *[f"## {name}\n\n{markdown_table(rows, columns)}" for name, (rows, columns) in tables.items()]]
    files.write_text("\n\n".join(parts) + "\n", path)


def split_errors(results: DataFrame, path: str, errors_path: str, keys: list[str]) -> None:
    """Appends rows without an error to one place, keys and errors of the others to another; ``results`` should be checkpointed."""
    results.filter("error IS NULL").drop("error").write.mode("append").parquet(path)
    failed = results.filter("error IS NOT NULL").select(*keys, "error.*")
    if not failed.isEmpty():
        failed.write.mode("append").parquet(errors_path)


def git_hash() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def environment() -> str:
    """The installed distributions and their versions, a line each."""
    from importlib.metadata import distributions

    return "\n".join(sorted({f"{d.metadata['Name']}=={d.version}" for d in distributions() if d.metadata["Name"]})) + "\n"


def run_folder(root: str | Path, experiment: str, seed: int) -> str:
    out = f"{root}/{experiment}_{seed}"
    files.make_folder(out)
    return out


def write_manifest(folder: str | Path, config: dict[str, Any]) -> dict[str, Any]:
    """Configuration, its hash, the environment and the identity of a run, a file each."""
    made = {
        "experiment_id": f"{config.get('experiment_name')}_{config.get('seed')}",
        "experiment_name": config.get("experiment_name"),
        "method": config.get("method"),
        "model": config.get("model"),
        "seed": config.get("seed"),
        "created_utc": datetime.now(timezone.utc).isoformat(),
        "config_hash": config_hash(config),
        "git_hash": git_hash(),
    }
    write_document(config, f"{folder}/config.json")
    write_settings(config, f"{folder}/config.yaml")
    files.write_text(made["config_hash"] + "\n", f"{folder}/config_hash.txt")
    files.write_text(environment(), f"{folder}/env.txt")
    write_document(made, f"{folder}/manifest.json")
    return made


class Timings:
    """Seconds of the stages of a run: ``with timings.stage("infer"): ...``; a stage that runs again adds to its time."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        begun = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - begun

    def rows(self) -> list[dict[str, Any]]:
        """A row for each stage and one for all, with minutes."""
        every = {**self.seconds, "total": sum(self.seconds.values())}
        return [{"stage": name, "seconds": round(s, 3), "minutes": round(s / 60, 2)} for name, s in every.items()]


def package(folders: list[str | Path], path: str | Path, timings: Timings | None = None) -> int:
    """A ZIP file of all local files below the folders, with a summary of ``timings``; the number of files."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder in map(Path, folders):
            for file in sorted(p for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")):
                out.write(file, str(file.relative_to(folder.parent)))
                n += 1
        if timings:
            out.writestr("timings.md", markdown_table(timings.rows(), ["stage", "seconds", "minutes"]) + "\n")
            n += 1
    return n
