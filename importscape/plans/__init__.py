"""What a user calls: the built graph, its views, and the registered queries."""
