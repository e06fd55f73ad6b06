"""Compositions of operators: module outputs and the run-level score stage."""
