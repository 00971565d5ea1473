"""Content-moderation analytics on Spark: rules, scores, cascades and reports over tables of posts."""
