"""DataFrame-in, DataFrame-out operators grouped as the reference's pages."""
