"""From formula text to a logical plan: tokens, syntax trees, rewrites, and lowering to Columns."""
