"""Deployments, the query language and its compiler."""
