"""Plan shapes shared by all operators: skew-safe ranking, quantiles, joins and grid joins."""
