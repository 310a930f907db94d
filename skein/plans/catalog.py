"""All queries of the core, by name, and their SQL."""

from skein.plans import events, incremental, relations, search, services, state

MODULES = (incremental, search, relations, services, state, events)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
