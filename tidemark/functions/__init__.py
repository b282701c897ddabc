"""Column-level functions: imputation, verdict labels, formulas, splines."""
