"""Sources and sinks: source trees, snapshots, alias configuration, graph documents."""
