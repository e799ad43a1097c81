"""Cleansing, aggregate tables, features, models and serving data sets."""
