"""Stream forms of the event operators."""
