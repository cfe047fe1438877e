"""Parameters that govern how much work a run does and what it counts, in one place; queries and command line use no others."""

from __future__ import annotations

# Fixed values of the workload.
PILOT_FRACTION, CONFIDENCE, PRECISION = 0.02, 0.95, 0.02
CLOSENESS_BATCH, EFFICIENCY_BATCH, BETWEENNESS_BATCH = 128, 32, 32
SEED = 42
BETWEENNESS_FRACTION, LEAST_SOURCES, MOST_SOURCES = 0.005, 100, 500
CELL_M, MOST_CELLS = 500.0, 2_000_000
BUILT_UP, COMBINE_KM = 0.005, 1.0
SEARCH_RADIUS_M, LEAST_CORE_KM2 = 15_000.0, 1.0
ENVELOPE_KM = 50.0
