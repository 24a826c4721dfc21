"""Whole analyses: the park report, and the registered queries over the shared test tables."""
