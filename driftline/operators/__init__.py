"""DataFrame -> DataFrame operators; all are lazy."""
