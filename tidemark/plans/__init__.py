"""Named queries over the test tables, and the same in DuckDB SQL."""
