"""Plinth: civic open data on Spark. Cleaning, identity, time series, cohorts, listings and publication as DataFrame operators."""
