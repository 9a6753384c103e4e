"""All registered queries and their SQL oracles, collected from the modules beside this one."""

from __future__ import annotations

from . import facts, paths, rewrites

MODULES = [facts, paths, rewrites]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict = {k: v for m in MODULES for k, v in m.ORACLE.items()}
