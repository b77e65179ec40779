"""Relational and search operators on nodes, edges and potentials."""
