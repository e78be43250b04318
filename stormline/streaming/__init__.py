"""The same operators on streams of landed files."""
