"""adflow: advertising analytics as Spark DataFrame operators.

Sub-packages:
  sources    table loading, fixture domain views, JSON ingest, sinks, snapshots
  functions  Column-expression building blocks (features, pricing, signing)
  operators  DataFrame -> DataFrame operators (joins, aggregates, windows)
  plans      composite jobs (auction, training) and the query catalogue
  streaming  Structured Streaming forms of ingest, state and auctions
"""

__version__ = "0.1.0"
