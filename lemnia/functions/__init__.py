"""Functions of the formula language as builders of Columns."""
