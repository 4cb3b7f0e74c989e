"""Plan helpers: staging of intermediate tables, and the query registry."""
