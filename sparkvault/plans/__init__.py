"""The registered queries of the library and their SQL."""

from sparkvault.plans import changes, rest, scalars, text

QUERIES = changes.QUERIES | scalars.QUERIES | text.QUERIES | rest.QUERIES
ORACLE = changes.ORACLE | scalars.ORACLE | text.ORACLE | rest.ORACLE
