"""Plan building blocks: staged tables, distributed numbering, lookups, runs."""
