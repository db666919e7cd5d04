"""arcweave: analytics on graphs held as DataFrames, written as sparse matrix algebra over semirings.

functions   labels of edges and how they add and multiply (algebras), path arrays, expressions
sources     graphs and vectors from Python values, tables and random draws
operators   vectors, matrices, set operations, products
plans       loops until nothing changes: levels, closures, components, and the graph queries on top
streaming   keeping an edge table up to date from a stream
"""
