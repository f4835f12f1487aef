"""The engine stands without its optional part, and both entry tables agree."""

from __future__ import annotations

from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_in_the_library_needs_the_optional_part():
    for path in (ROOT / "tremorlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tremorlake.llm" not in path.read_text(), path


def test_no_local_checkpoint_and_no_rdd_code():
    for path in (ROOT / "tremorlake").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".rdd" not in text, path


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
