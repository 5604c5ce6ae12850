"""Systems composed of operators, their runner, and the registry of queries."""
