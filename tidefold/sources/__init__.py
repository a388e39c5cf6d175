"""Files and generators that bars come from, and sinks."""
