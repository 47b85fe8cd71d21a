"""From options to a logical plan: key rules, option checks and the conversion."""
