"""Table operators: filtering, enrichment, dictionary matching, merging."""
