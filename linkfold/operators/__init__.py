"""DataFrame -> DataFrame operators: pairs, rounds, the fixpoint loop, reports, k-means."""
