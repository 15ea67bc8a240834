"""Spark-native search and analytics over a corpus of legal and parliamentary documents."""
