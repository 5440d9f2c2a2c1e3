"""texlake: math-bearing text at table scale, on Spark."""
