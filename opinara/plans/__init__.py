"""Compositions of operators: chart tables, report, questions and answers."""
