"""Graph, ordering, batching and message operators."""
