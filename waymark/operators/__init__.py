"""Address parsing, predicates, search, geocoding."""
