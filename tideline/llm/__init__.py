"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; scratch data go to the shared folder named by
``spark.checkpoint.dir`` (see :mod:`tideline.llm.store`).
"""
