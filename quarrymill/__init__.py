"""Corpus analytics on Spark: text, retrieval, graph, window and evaluation operators as DataFrame plans."""
