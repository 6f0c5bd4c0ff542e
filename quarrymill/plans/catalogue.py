"""All registered queries and their SQL, family by family."""

from __future__ import annotations

from quarrymill.plans import candidates, curation, drawings, elements, events, files, pixels, records, reports, sheets, streams, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (candidates, records, pixels, texts, events, elements, drawings, sheets, streams, reports, curation, files):
    QUERIES |= _module.family.queries
    ORACLES |= _module.family.oracles
