"""Tessera: retrieval, conversation and corpus analytics expressed as Spark DataFrames."""
