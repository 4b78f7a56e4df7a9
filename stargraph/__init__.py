"""stargraph: review-graph analytics expressed as Spark DataFrame plans.

Sub-packages:
  sources    – table loading, CSV/TSV/JSON-lines readers and writers, graph table storage
  functions  – column expressions (text cleaning, coercion, labels, context lines, JSON bodies)
  operators  – canonical reviews, keyed upsert, bot filter, aggregates, graph construction, co-purchase pairs, graph patterns
  plans      – the intent queries, subgraph assembly, retrieval contexts, the query registry
  streaming  – incremental idempotent reload with Structured Streaming
"""
__version__ = "0.1.0"
