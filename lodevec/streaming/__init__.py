"""A stream of queries against a static corpus."""
