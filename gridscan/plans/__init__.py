"""Plan building blocks shared by the operators: ordering, lineage, end-to-end scans."""
