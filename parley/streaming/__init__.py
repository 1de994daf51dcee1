"""The same operators on streams of exports and messages."""
