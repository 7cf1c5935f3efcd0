"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus the names of its key and text columns, reads only those, and
returns new columns, so extra input columns of any name cannot clash.
"""
