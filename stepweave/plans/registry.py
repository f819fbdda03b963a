"""All registered queries of the core, and their SQL oracles."""

from __future__ import annotations

from stepweave.plans import experiments, general, paired, roundtrips, scores, strict

FLAGSHIP = "cluster_top_features"
QUERIES = general.QUERIES | scores.QUERIES | experiments.QUERIES | strict.QUERIES | paired.QUERIES | roundtrips.QUERIES
ORACLE = general.ORACLE | scores.ORACLE | experiments.ORACLE | strict.ORACLE | paired.ORACLE | roundtrips.ORACLE
