"""Revenue recognition, version comparison, table reconciliation and data profiling on Spark.

Every operator takes DataFrames or Columns and returns DataFrames or Columns;
nothing here runs Python code per row.
"""
