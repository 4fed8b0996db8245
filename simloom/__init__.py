"""simloom: similarity analytics on Spark DataFrames.

Relational work stays in lazy DataFrame plans; dense numeric kernels run in
Arrow functions over task grids; randomness comes from hash columns.
"""
