"""The queries of the driver contract and their SQL, by area."""

from codeloom.queries import analyses, catalog, integrity, operations, relations, requests, retrieval, scalars, structures

AREAS = (catalog, relations, retrieval, operations, analyses, integrity, scalars, structures, requests)
