from .tables import TABLES, load_table, Tables  # noqa: F401
