"""What the jobs share: settings from a small JSON file, and their log."""

from __future__ import annotations

import json
import logging
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from tremorlake.checks import DataError

T = TypeVar("T")


def load(kind: type[T], path: str | Path) -> T:
    """The dataclass filled from the file beside the command line; names that it doesn't have are errors."""
    told = json.loads(Path(path).read_text())
    unknown = sorted(set(told) - {f.name for f in fields(kind)})
    if unknown:
        raise DataError(f"{path}: unknown settings {unknown}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})


def show_log() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
