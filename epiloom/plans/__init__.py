"""Queries over the test tables, one or more for each operator: registered plans and the SQL they must agree with."""
