"""arcwright: a directed-graph analytics engine expressed as Spark plans."""
