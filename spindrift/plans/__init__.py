"""From query text to linear paths: patterns, predicates and the parser."""
