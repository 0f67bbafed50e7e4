"""Analytical operators: windows, features, consensus, rules, temporal, retrieval, metrics, clustering."""
