"""Operators of a training-data pipeline: URL rules, dedup at three levels, cleaning, scoring, mixing."""
