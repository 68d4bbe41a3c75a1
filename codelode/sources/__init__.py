from codelode.sources.tables import read_table, tables  # noqa: F401
