"""Thresholds of imports from settings."""

import pytest

from tarnspark.operators.matching import MatchOptions, options_of


def test_options():
    assert options_of({}, "a.") == MatchOptions()
    got = options_of({"a.radius_m": "500", "a.candidates": "3", "a.accept_margin": "", "b.radius_m": "x"}, "a.")
    assert got == MatchOptions(radius_m=500.0, candidates=3) and isinstance(got.candidates, int)
    with pytest.raises(ValueError, match="colour"):
        options_of({"a.colour": "1"}, "a.")
    with pytest.raises(ValueError):
        options_of({"a.radius_m": "far"}, "a.")
