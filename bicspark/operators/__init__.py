"""DataFrame operators: cells, triples, ranges, itemsets, concepts, prediction."""
