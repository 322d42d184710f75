"""Plans over several operators: the operation log's fold, transactions, commands, queries."""
