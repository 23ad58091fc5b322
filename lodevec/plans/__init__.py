"""Query planning: from a regular expression to the trigrams it needs."""
