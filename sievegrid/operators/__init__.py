"""Operators on frames, scores, budgets, answers, metrics and file trees."""
