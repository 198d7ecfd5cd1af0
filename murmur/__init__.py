"""Murmur: ensemble data assimilation, ensemble optimisation and corpus operators on Spark."""
