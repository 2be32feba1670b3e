"""Canonical relations. A missing allele is NULL; marker and haplotype numbers start at 0."""

from __future__ import annotations

SAMPLES = "sample_idx int, sample_id string, is_diploid boolean"
MARKERS = "chrom string, marker_idx int, pos int, end int, id string, ref string, alts array<string>, n_alleles int, gen_pos double"
GENOTYPES = "chrom string, pos int, id string, ref string, alts array<string>, end int, sample_idx int, sample_id string, a1 int, a2 int, phased boolean, haploid boolean, conf int"
GENETIC_MAP = "chrom string, pos int, cm double"
SITE_QUALITY = "chrom string, pos int, af array<double>, dr2 array<double>, imputed boolean"
