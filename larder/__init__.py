"""Retail inventory and demand analytics as Spark DataFrame operators.

Every operator takes DataFrames plus plain parameters and returns a DataFrame.  Nothing here reads rows
back to the driver except where a bounded answer is needed to shape the plan (a category vocabulary of at
most eleven values, a one-row size check) or where Spark ML itself runs jobs to fit a model.
"""

__version__ = "0.1.0"
