"""cartsight: commerce analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame. Nothing runs until the caller asks for
rows, except the functions in ``sources.stored``, whose purpose is to write.
"""
