"""Plan builders: inputs, storage of intermediate tables, and whole drawings."""
