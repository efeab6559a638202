"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from . import contigs, general, io, mapped, reads, rewriting, ways

QUERIES = {**general.QUERIES, **reads.QUERIES, **contigs.QUERIES, **rewriting.QUERIES, **ways.QUERIES, **mapped.QUERIES, **io.QUERIES}
SQL = {**general.SQL, **reads.SQL, **contigs.SQL, **rewriting.SQL, **ways.SQL, **mapped.SQL, **io.SQL}
