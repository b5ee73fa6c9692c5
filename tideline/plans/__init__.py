"""Tables with keys and versions, and map and reduce jobs."""
