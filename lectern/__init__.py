"""lectern: document analytics and retrieval as Spark DataFrame plans."""
