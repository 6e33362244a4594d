"""End-to-end plans, table bindings and the query registry."""
