"""Column expressions: vector maths, id order, the SQL-body relabel function."""
