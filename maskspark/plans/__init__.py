"""Query plans: the rewriting of masked roles' SQL, and the registered queries."""
