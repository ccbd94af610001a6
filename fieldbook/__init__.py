"""fieldbook: player-performance features, line pricing and pick-ledger evaluation as Spark jobs."""

__version__ = "0.1.0"
