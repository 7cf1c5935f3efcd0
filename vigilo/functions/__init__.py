"""Column expressions: lenient JSON reads, scoring rules, features, joins."""
