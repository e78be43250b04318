"""DataFrame transforms; every function takes and returns DataFrames."""
