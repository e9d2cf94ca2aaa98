"""From a request to a Spark plan: validation, tile pruning, level choice, assembly."""
