"""Planning: names, joins, normal forms, routing. Plain Python over frozen values."""
