"""Road-network and corpus analytics expressed as Spark plans."""
