"""Java source to typed facts; plain Python that runs inside one Arrow stage."""
