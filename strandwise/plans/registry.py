"""All queries of the core library with their SQL."""

from __future__ import annotations

from strandwise.plans import genomics, problems, verdicts

MODULES = (genomics, verdicts, problems)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "gated_composite"
