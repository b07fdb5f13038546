"""Operators for preparing large text corpora, one module per operator.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames, keeps its working tables in the folder named by
``spark.checkpoint.dir`` and never gathers documents on the driver.
"""
