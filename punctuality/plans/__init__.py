"""Whole plans: curation, model table, training, forecasting, layout experiment, export."""
