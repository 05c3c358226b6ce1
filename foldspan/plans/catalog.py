"""All core queries and their SQL counterparts."""

from __future__ import annotations

from foldspan.plans import audits, comparing, corpora, logs, profiles, records, replays, scalars, sequences, storage

_MODULES = (records, replays, profiles, sequences, comparing, logs, audits, storage, scalars, corpora)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
