"""DataFrame-in, DataFrame-out operators; every table carries its run key."""
