"""newsgraph: event-centred news analytics and corpus preparation as Spark plans."""
