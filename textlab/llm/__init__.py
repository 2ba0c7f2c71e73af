"""Operators of a large-scale training-data pipeline (README, section "Training-data operators")."""
