"""All queries of this subpackage and the SQL of those that SQL can express."""

from keystrata.llm import keys, texts

MODULES = [keys, texts]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
