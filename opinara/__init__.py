"""Opinion analytics on Spark: threads, stance evaluation, graphs, movement and polarization as DataFrame plans."""
