"""tessera: collaborative memory retrieval and episode construction as Spark plans."""
