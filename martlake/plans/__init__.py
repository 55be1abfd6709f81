"""Whole plans: reports, the task graph, the lakehouse run and the registered queries."""
