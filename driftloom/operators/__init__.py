"""Operators on tables: joins with checks, sequences, scores, signals, audits, panels and fits."""
