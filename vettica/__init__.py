"""Source-code and text auditing as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame.  See README.md
for the list of operators and what each needs from its input.
"""
