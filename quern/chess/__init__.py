"""Chess plug-in: rules, boards as rows, task generators."""
