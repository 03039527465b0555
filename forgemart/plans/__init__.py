"""Whole questions: the measure evaluator and the rule-book analyses."""
