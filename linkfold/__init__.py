"""linkfold: connected components and k-means as Spark DataFrame operators.

Sub-packages
------------
sources    readers for edge lists / vectors and the graphs built from the driver tables, sinks
operators  pair operators, the component round (four strategies), the fixpoint loop, reports, k-means
functions  column expressions (vector maths, id order) and the SQL-body relabel function
plans      the registered queries and their DuckDB oracles
shipping   the package as a Python file of a running session
llm        operators for training data (optional; nothing else imports it)
"""

from linkfold.operators.components import connected_components, ComponentsResult
from linkfold.operators.rounds import cc_round, STRATEGIES

__all__ = ["connected_components", "ComponentsResult", "cc_round", "STRATEGIES"]
