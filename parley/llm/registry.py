"""The registered queries of this subpackage, and their SQL."""

from . import decontaminate, fingerprints, language, lines, manifest, near_copies, neighbours, packing, personal, secrets, spelling, toxicity, warc

MODULES = [decontaminate, fingerprints, language, lines, manifest, near_copies, neighbours, packing, personal, secrets, spelling, toxicity, warc]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
