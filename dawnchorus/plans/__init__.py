"""Compositions of operators: import flow, report, event study, query catalog."""
