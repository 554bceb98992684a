"""Whole computations users call: cleaning, tidying, planning, forecasting, training, shelf scoring."""
