"""The query language: tree, wire form, types and checks."""
