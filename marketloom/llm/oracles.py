"""SQL twins, for DuckDB, of the queries that SQL can express: none, as each trains, hashes, tokenises or writes files; tests hold them against brute force."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {}
