"""The same operators on unbounded tables."""
