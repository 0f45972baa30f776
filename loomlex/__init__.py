"""loomlex: document topic modelling and entity-mention analysis on Spark.

Sub-packages: ``functions`` (column expressions), ``sources`` (scans and
catalogs), ``operators`` (tokens, ids, weights, topic summaries, entities),
``plans`` (MLlib models, composite jobs, registered queries), ``sinks`` and
``streaming``.
"""

__version__ = "0.1.0"
