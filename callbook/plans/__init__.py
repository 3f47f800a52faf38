"""The analytical questions, each a composition of operators."""
