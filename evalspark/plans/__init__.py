"""Plan-shaping helpers shared by the operators: lineage cuts, joins that survive
hot keys, order statistics, and consecutive numbering."""
