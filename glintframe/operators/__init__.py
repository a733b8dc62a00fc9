"""Operators over movies, traces, footprints and seeds.

A movie is long, (frame, height, width, value), dense, with coordinates from 0.
Every operator takes `by`, columns that tell several movies or parts apart, and
which prefix all its keys.
"""

PIXEL = ["height", "width"]
VOXEL = ["frame", "height", "width"]
