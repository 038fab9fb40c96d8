"""Triple histories on Spark: an append-only log of signed triples, its live state and time travel, and stratified rules over it."""
