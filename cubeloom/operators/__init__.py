"""DataFrame operators that a logical plan is lowered to."""
