"""Forecasters, validation folds and model selection over all series at once."""
