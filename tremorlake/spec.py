"""What a study is: its span, its scan settings, and the rules that are its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


class SettingsError(ValueError):
    """Settings that make no sense."""


# Fixed values.
@dataclass(frozen=True)
class ScanSettings:
    simulations: int = 5000
    seed: int = 20260922
    step_s: int = 60
    window_minutes: tuple[float, ...] = (1, 2, 5, 10, 20, 30, 60)
    radius_cm: float = 35.0
    min_records: int = 5
    min_active: int = 3
    alpha: float = 0.05
    family: int = 3
    batch: int = 200

    def checked(self) -> ScanSettings:
        wrong = [
            name
            for name, ok in (
                ("simulations", self.simulations >= 1),
                ("step_s", self.step_s > 0),
                ("window_minutes", bool(self.window_minutes) and min(self.window_minutes) > 0),
                ("radius_cm", self.radius_cm > 0),
                ("min_records", self.min_records >= 1),
                ("min_active", self.min_active >= 2),
                ("alpha", 0 < self.alpha < 1),
                ("family", self.family >= 1),
                ("batch", self.batch >= 1),
            )
            if not ok
        ]
        if wrong:
            raise SettingsError(f"settings out of range: {', '.join(wrong)}")
        return self


@dataclass(frozen=True)
class ExperimentSpec:
    """A study's span in microseconds and the steps that differ between studies."""

    name: str
    start_us: int
    end_us: int
    scan: ScanSettings = field(default_factory=ScanSettings)
    operation_status: Callable[[DataFrame], DataFrame] | None = None
    calibration_times: Callable[[DataFrame], DataFrame] | None = None
    reference_sampler: Callable[[DataFrame], DataFrame] | None = None
    tagger: Callable[[DataFrame], DataFrame] | None = None
    metadata_verified: bool = False

    def require_verified(self) -> None:
        """A full run needs the files' metadata to have been checked."""
        if not self.metadata_verified:
            raise SettingsError(f"{self.name}: file metadata isn't verified")


def deep_get(config: dict[str, Any], path: tuple[str, ...], default: Any = None) -> Any:
    """A nested value, the default where a level is missing."""
    for key in path:
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config
