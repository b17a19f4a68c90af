"""Schemas of the tables that the jobs exchange."""

from __future__ import annotations

#: The clean log: one row for each change of a pixel.
LOG = "event_id bigint, seconds double, x int, y int, user bigint, color int, moderator boolean"
#: Pixels of compositions with the time ranges in which they belong to them.
COMP_PIXELS = "comp_id string, x int, y int, t0 double, t1 double"
#: Nested entries of an atlas of compositions.
ATLAS = "id string, name string, description string, links map<string,array<string>>, path map<string,array<array<int>>>"
#: Raw rows of the oldest log layout.
OLD_LOG = "ts string, user_hash string, x_coordinate int, y_coordinate int, color int"
