"""Parameters of a canvas and of its analysis, as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Section:
    """Part of the canvas that opens at `t_open`; bounds are inclusive."""

    section: int
    t_open: float
    xmin: int
    xmax: int
    ymin: int
    ymax: int


@dataclass(frozen=True)
class Canvas:
    """One canvas event: its length, end phases, sections, palette steps and rate limit."""

    total: float
    whiteout: float
    greyout: float
    sections: tuple[Section, ...]
    white: int
    palette_steps: tuple[tuple[float, int], ...]
    cooldown: float
    bin_width: float
    window: int


DAY = 86400.0

#: The canvas that the driver's `events` are read as: ten by ten pixels, thirty days, bins of six hours.
TEST_CANVAS = Canvas(
    total=30 * DAY,
    whiteout=29 * DAY,
    greyout=28 * DAY,
    sections=(Section(0, 0.0, 0, 4, 0, 9), Section(1, 5 * DAY, 0, 9, 0, 9)),
    white=4,
    palette_steps=((0.0, 3), (10 * DAY, 4), (20 * DAY, 5)),
    cooldown=DAY / 4,
    bin_width=DAY / 4,
    window=8,
)
