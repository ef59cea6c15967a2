"""Compositions of the operators into whole pipelines."""
