"""Discussion-thread analytics on Spark: trees, branches, features, stance and claim scoring."""
