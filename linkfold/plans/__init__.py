"""The registered queries (``catalog``) and their DuckDB oracles (``oracle``)."""
