"""The corpus pipeline as a registered query."""

from __future__ import annotations

import corpus_pipeline

from callgrove.workload.registry import Registry

R = Registry()
R.query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
