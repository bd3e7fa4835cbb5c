"""Text inputs and table outputs."""
