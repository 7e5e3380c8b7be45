"""Plan builders: cutting lineage, exact splits of hot groups, bounded local finishing."""
