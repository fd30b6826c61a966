"""spanweave: network routing, vulnerability analysis and corpus operators as Spark plans."""
