"""Operations of a training-data pipeline over documents, pages and vectors.

Nothing else in the library imports this package. Every operator reads its
columns by name: extra columns, also such that are named like a result column,
are ignored. Results of an operator are declared in its docstring.
"""
