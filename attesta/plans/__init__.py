"""The queries of the library, by family; each module has ``queries()`` and ``oracle_sql()``."""

from attesta.plans import corpus, evidence, keys, later, rounds, streams, work

MODULES = [corpus, evidence, work, keys, rounds, streams, later]
