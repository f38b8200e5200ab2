"""Sources, sinks and the fixture adapters that map the given tables to the
transaction schema."""
