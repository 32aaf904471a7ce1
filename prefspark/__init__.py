"""Preference-data preparation, selection and rollout arithmetic as PySpark DataFrame operators."""
