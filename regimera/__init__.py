"""regimera: a Spark-first engine for operating-mode analytics over sensor and event tables."""
