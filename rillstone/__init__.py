"""rillstone: changelog-aware stream and table analytics expressed as Spark plans."""
