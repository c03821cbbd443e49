"""All queries of the core, by name, with the SQL of those that SQL can express."""

from webloom import engine_queries, problem_queries

QUERIES = {**problem_queries.QUERIES, **engine_queries.QUERIES}
SQL = {**problem_queries.SQL, **engine_queries.SQL}
