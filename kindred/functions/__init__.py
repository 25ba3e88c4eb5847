"""Part of the entity resolution engine."""
