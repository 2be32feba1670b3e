"""Genotype phasing, imputation and accuracy evaluation expressed as Spark plans."""
