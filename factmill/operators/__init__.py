"""Operators on DataFrames: profiles, matching, ranking, roll-ups, jobs, evaluation, usage."""
